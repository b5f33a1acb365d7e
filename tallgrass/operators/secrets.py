"""Keys in source code: assignments of key-like values, and references to environment variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, first_case, stable_id, starts_with_any, strip
from tallgrass.operators.joins import key_band
from tallgrass.sources.corpus import skipped_by_secrets

# Patterns of hard-coded keys (name and value; the ninth is a value alone) and of references.
HARD_CODED = (
    r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*["']([^"']{16,})["']""",
    r"""(?i)(secret[_-]?key|secretkey|secret[_-]?access[_-]?key)\s*[:=]\s*["']([^"']{16,})["']""",
    r"""(?i)(access[_-]?token|accesstoken)\s*[:=]\s*["']([^"']{16,})["']""",
    r"""(?i)(auth[_-]?token|authtoken)\s*[:=]\s*["']([^"']{16,})["']""",
    r"""(?i)(bearer[_-]?token|bearertoken)\s*[:=]\s*["']([^"']{16,})["']""",
    r"""(?i)(aws[_-]?access[_-]?key[_-]?id|aws_access_key_id)\s*[:=]\s*["'](AKIA[0-9A-Z]{16})["']""",
    r"""(?i)(aws[_-]?secret[_-]?access[_-]?key|aws_secret_access_key)\s*[:=]\s*["']([^"']{20,})["']""",
    r"""(?i)(github[_-]?token)\s*[:=]\s*["'](ghp_[a-zA-Z0-9]{36})["']""",
    r"""(?i)(ghp_[a-zA-Z0-9]{36})()""",
    r"""(?i)(firebase[_-]?api[_-]?key|firebase_api_key)\s*[:=]\s*["']([A-Za-z0-9_-]{20,})["']""",
    r"""(?i)(stripe[_-]?[a-z]*[_-]?key|stripe[_-]?secret)\s*[:=]\s*["'](sk_[a-z0-9_]{20,})["']""",
    r"""(?i)(private[_-]?key|public[_-]?key|encryption[_-]?key)\s*[:=]\s*["']([^"']{20,})["']""",
)
REFERENCES = (
    r"(?i)process\.env\.([A-Z_][A-Z0-9_]*)",
    r"""(?i)os\.getenv\(["']([^"']+)["']""",
    r"""(?i)os\.environ\[["']([^"']+)["']""",
    r"""(?i)env\[["']([^"']+)["']""",
    r"(?i)\$\{([A-Z_][A-Z0-9_]*)\}",
    r"""(?i)System\.getenv\(["']([^"']+)["']""",
)
# Provider by part of a key's name, the first held decides; then by the value's beginning.
PROVIDERS = (
    (("anthropic", "claude"), "anthropic"), (("openai", "gpt"), "openai"), (("copilot",), "github_copilot"), (("google_ai", "gemini"), "google_ai"), (("cohere",), "cohere"), (("huggingface", "hf_"), "huggingface"),
    (("replicate",), "replicate"), (("together",), "together_ai"), (("mistral",), "mistral_ai"), (("perplexity",), "perplexity"), (("aws", "amazon"), "aws"), (("github", "ghp_"), "github"), (("firebase",), "firebase"),
    (("google", "gcp"), "gcp"), (("azure",), "azure"), (("stripe",), "stripe"), (("twilio",), "twilio"), (("sendgrid",), "sendgrid"), (("mailgun",), "mailgun"), (("vercel",), "vercel"), (("netlify",), "netlify"),
)
VALUES = ((("ghp_",), "github"), (("sk_live_", "sk_test_"), "stripe"), (("AKIA",), "aws"))
PREVIEW = 20
SCANNED = (".js", ".ts", ".jsx", ".tsx", ".py", ".rs", ".go", ".java", ".rb", ".php", ".env")
USED_BY = 20
KEY = "array<struct<name:string,value:string,key_type:string,line_number:int>>"


def provider_of(name: Column, value: Column) -> Column:
    low = F.lower(name)
    cases = [(any_of(low, *parts), p) for parts, p in PROVIDERS]
    return first_case([*cases, *[(F.coalesce(starts_with_any(value, *v), F.lit(False)), p) for v, p in VALUES]], "generic")


def count_of(value: Column, part: str) -> Column:
    return F.size(F.split(value, "[" + part + "]", -1)) - 1


# What shows that a value refers to something, that a line documents or declares, and names of keys.
REFERRING = ("${", "$(", "{{", "process.env", "process['env']", 'process["env"]', "getenv", "environ", "config.", "env.", "process.")
COMMENTS = ("//", "#")
COMMENT_PARTS = ("/*", "*/", "<!--")
DECLARING = ("interface", "typedef")
OTHER_TOKENS = ("jsonwebtoken", "jwt", "csrf", "refresh", "session")
DOCUMENTING = ("example", "sample", "placeholder", "your_", "replace_")
KEY_VARIABLES = ("secret", "token", "auth", "credential", "password", "access")


def looks_like_key(value: Column) -> Column:
    """Not a template, reference, URL, path or phrase; 20 bytes or more; at least 70 % letters and digits."""
    v = F.regexp_replace(strip(value), "^[\"'`]+|[\"'`]+$", "")
    reference = any_of(v, *REFERRING) | v.startswith("$")
    access = v.contains(".") & (count_of(v, ".") <= 2) & (F.octet_length(v) < 40) & ~v.rlike(r"(?U)[^\p{Alnum}._${}]")
    path = v.contains("://") | (count_of(v, "/") > 1) | v.contains("\\")
    spaced = v.contains(" ") & ~starts_with_any(v, "sk_", "pk_")
    dotted = (count_of(v, ".") > 2) & ~v.startswith("sk_")
    letters = F.length(F.regexp_replace(v, r"(?U)[^\p{Alnum}]", "")) / F.length(v)
    return ~reference & ~access & (F.octet_length(v) >= 20) & ~path & ~spaced & ~dotted & (letters >= 0.7)


def false_positive(line: Column, name: Column) -> Column:
    """Comments, type definitions, other kinds of token, and documentation's examples."""
    low, key = F.lower(line), F.lower(name)
    lead = F.ltrim(low)
    comment = starts_with_any(lead, *COMMENTS) | any_of(low, *COMMENT_PARTS)
    bare = (key == "key") & ~any_of(low, "api", "secret")
    typed = any_of(low, *DECLARING) | (low.contains("type ") & low.contains("="))
    parameter = low.contains("function") & F.contains(low, key) & ~low.contains("=")
    other = key.contains("token") & any_of(low, *OTHER_TOKENS)
    return comment | bare | typed | parameter | other | any_of(low, *DOCUMENTING)


def is_key_variable(name: Column) -> Column:
    low = F.lower(name)
    return (low.contains("api") & low.contains("key")) | any_of(low, *KEY_VARIABLES)


def keys_in_line(line: Column, i: Column, extra: tuple[str, ...] = ()) -> Column:
    """Keys of one line: rule after rule. extra: patterns of two groups from plugin rules."""

    def hard(pattern: str) -> Column:
        names, values = (F.regexp_extract_all(line, F.lit(pattern), F.lit(k)) for k in (1, 2))
        made = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.when(v != "", v).alias("value"), F.lit("hardcoded").alias("key_type"), (i + 1).cast("int").alias("line_number")))
        generic = lambda k: F.lower(k["name"]).isin("apikey", "api_key") & k["value"].isNotNull()
        return F.filter(made, lambda k: ~false_positive(line, k["name"]) & (~generic(k) | looks_like_key(k["value"])))

    def reference(pattern: str) -> Column:
        names = F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), is_key_variable)
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("value"), F.lit("env_var").alias("key_type"), (i + 1).cast("int").alias("line_number")))

    return F.concat(*[hard(p) for p in (*HARD_CODED, *extra)], *[reference(p) for p in REFERENCES])


def detect_keys(files: DataFrame, elements: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Keys with provider, context (two lines around), a 20-character preview, and the elements within 50 lines."""
    scanned = ends_with_any(F.col("low_name"), *SCANNED) | F.col("low_name").contains("config")
    used = files.where((~skipped_by_secrets() | F.col("low_name").startswith(".env")) & scanned)
    lines = F.col("lines")
    found = F.flatten(F.transform(lines, lambda x, i: F.when(F.length(x) > 5, keys_in_line(x, i, extra)).otherwise(F.array().cast(KEY))))
    rows = used.select("repository_id", F.col("path").alias("file_path"), "lines", F.posexplode(found).alias("ord", "k"))
    at = F.col("k.line_number")
    begin = F.greatest(at - 2, F.lit(1))
    context = F.array_join(F.slice(lines, begin, F.least(at + 2, F.size(lines)) - begin + 1), "\n")
    value = F.col("k.value")
    keys = rows.select(
        stable_id(F.lit("key"), F.col("repository_id"), F.col("file_path"), F.col("ord"), F.col("k.name")).alias("id"),
        "repository_id",
        F.col("k.name").alias("key_name"),
        F.col("k.key_type").alias("key_type"),
        provider_of(F.col("k.name"), value).alias("provider"),
        F.when(F.length(value) > PREVIEW, F.concat(F.substring(value, 1, PREVIEW), F.lit("..."))).otherwise(value).alias("value_preview"),
        "file_path",
        at.alias("line_number"),
        context.alias("context"),
    )
    if elements is None:
        return keys.withColumn("used_by", F.array().cast("array<string>"))
    near = key_band(keys, elements).groupBy("key_id").agg(F.slice(F.array_sort(F.collect_set("element_id")), 1, USED_BY).alias("used_by"))  # elements of one file within 50 lines
    return keys.join(near, keys["id"] == near["key_id"], "left").drop("key_id").withColumn("used_by", F.coalesce("used_by", F.array().cast("array<string>")))


def key_entities(keys: DataFrame) -> DataFrame:
    config = F.map_filter(F.create_map(F.lit("key_name"), F.col("key_name"), F.lit("key_type"), F.col("key_type"), F.lit("provider"), F.col("provider"), F.lit("value_preview"), F.col("value_preview")), lambda k, v: v.isNotNull())
    return keys.select("id", "repository_id", F.lit("api_key").alias("entity_type"), F.concat("key_name", F.lit(" ("), "provider", F.lit(")")).alias("name"), "provider", config.alias("configuration"), "file_path", "line_number", F.lit(None).cast("string").alias("arn"), F.lit(None).cast("string").alias("region"))


def key_vulnerabilities(keys: DataFrame) -> DataFrame:
    hard = keys.where(F.col("key_type") == "hardcoded")
    return hard.select(F.concat("id", F.lit(":vuln:hardcoded")).alias("id"), "repository_id", F.col("id").alias("entity_id"), F.lit("HardcodedApiKey").alias("vulnerability_type"), F.lit("Critical").alias("severity"), F.concat(F.lit("Hard-coded key: "), "key_name").alias("description"), F.lit("Keep it in the environment or in a secret store.").alias("recommendation"), "file_path", "line_number")
