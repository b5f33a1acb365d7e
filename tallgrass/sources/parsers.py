"""General parsers for configuration, infrastructure and CI files: format or platform, provider, and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, first_case, strip

# What a file is by its lower-cased path, the first that fits.
INFRASTRUCTURE = (("terraform", "cloudformation", "pulumi", "serverless.yml", "serverless.yaml"), (".tf", ".tfvars"))
CI = ((".github/workflows", ".gitlab-ci", "jenkinsfile", "circleci", ".travis.yml", "azure-pipelines"), ())
CONFIG = (("package.json", "requirements.txt", "cargo.toml", "pom.xml", "go.mod"), (".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".config"))
DOCUMENTATION = (("readme", "license", "changelog"), (".md", ".rst", ".txt"))
CODE = ((), (".rs", ".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".cs", ".php", ".rb", ".swift", ".kt", ".scala"))
KINDS = {"infrastructure": INFRASTRUCTURE, "ci_cd": CI, "config": CONFIG, "documentation": DOCUMENTATION, "code": CODE}
PLATFORMS = ("github", "gitlab", "jenkins", "circleci", "travis", "azure")
PROVIDERS = ((("aws", "amazon"), "aws"), (("azure",), "azure"), (("google", "gcp"), "gcp"), (("kubernetes", "k8s"), "kubernetes"))


def file_kind(low_path: Column) -> Column:
    return first_case([((any_of(low_path, *parts) if parts else F.lit(False)) | (ends_with_any(low_path, *ends) if ends else F.lit(False)), kind) for kind, (parts, ends) in KINDS.items()], "other")


def provider(low_content: Column) -> Column:
    return first_case([(any_of(low_content, *words), p) for words, p in PROVIDERS], "unknown")


def parsed_files(files: DataFrame) -> DataFrame:
    """path, kind, format (of configuration), platform (of CI), provider and resources (of infrastructure)."""
    kind = file_kind(F.col("low_path"))
    yaml, tf = F.col("ext").isin("yaml", "yml"), F.col("ext").isin("tf", "tfvars")
    named = F.transform(F.filter(F.transform("lines", strip), lambda x: x.startswith('resource "')), lambda x: F.regexp_extract(x, '^resource "([^"]*)"', 1))
    # names one level below the Resources key of block YAML
    after = F.coalesce(F.get(F.split("content", r"(?md)^Resources:[^\n]*\n", 2), F.lit(1)), F.lit(""))
    block = F.substring(F.split(F.concat(F.lit("\n"), after), r"\n(?=[^ \t\n])", 2)[0], 2, 1 << 30)

    def level(b: Column, indent: Column) -> Column:
        named = F.filter(F.split(b, "\n"), lambda x: F.startswith(x, indent) & x.rlike(r"^[ \t]+[\w-]+:\s*$") & (F.length(F.regexp_extract(x, r"^[ \t]*", 0)) == F.length(indent)))
        return F.transform(named, lambda x: F.regexp_extract(x, r"([\w-]+):", 1))

    # each worked out once a file, not once a line
    keys = F.flatten(F.transform(F.array(block), lambda b: F.flatten(F.transform(F.array(F.regexp_extract(b, r"^([ \t]+)", 1)), lambda i: level(b, i)))))
    by_yaml = first_case([(F.col("content").rlike(r"(?m)^AWSTemplateFormatVersion:"), "aws"), (F.col("content").rlike(r"(?m)^apiVersion:") & F.col("content").rlike(r"(?m)^kind:"), "kubernetes")], "unknown")
    infra, none, null = F.col("kind") == "infrastructure", F.array().cast("array<string>"), F.lit(None).cast("string")
    df = files.withColumn("kind", kind)
    format_ = first_case([(F.col("ext") == "json", "json"), (yaml, "yaml"), (F.col("ext") == "toml", "toml")], "text")
    return df.select(
        "repository_id",
        "path",
        "kind",
        F.when(F.col("kind") == "config", format_).otherwise(null).alias("format"),
        F.when(F.col("kind") == "ci_cd", first_case([(F.col("low_path").contains(p), p) for p in PLATFORMS], "unknown")).alias("platform"),
        F.when(infra, first_case([(tf, provider(F.lower("content"))), (yaml, by_yaml)], "unknown")).alias("provider"),
        F.when(infra, first_case([(tf, named), (yaml, keys)], none)).otherwise(none).alias("resources"),
    )
