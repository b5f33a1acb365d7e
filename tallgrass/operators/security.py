"""Security entities and findings of infrastructure code, rules and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, first_case, strip
from tallgrass.sources.corpus import skipped_by_security

RESOURCES = {"aws_iam_role": "iam_role", "aws_iam_policy": "iam_policy", "aws_lambda_function": "lambda_function", "aws_s3_bucket": "s3_bucket", "aws_security_group": "security_group"}
TEMPLATE_RESOURCES = {"AWS::IAM::Role": "iam_role", "AWS::IAM::Policy": "iam_policy", "AWS::Lambda::Function": "lambda_function", "AWS::Serverless::Function": "lambda_function", "AWS::S3::Bucket": "s3_bucket"}
BLOCK_LINES = 100
ENTITY_SCHEMA = "id string, repository_id string, entity_type string, name string, provider string, configuration map<string,string>, file_path string, line_number int, arn string, region string, body string"
PREVIEW = 500

RECOMMENDATIONS = {
    "OverlyPermissiveAssumeRolePolicy": ("High", "The role can be assumed too widely.", "Name the principals that may assume the role."),
    "WildcardAction": ("Critical", "The policy allows every action.", "List the actions that are needed."),
    "WildcardResource": ("Critical", "The policy covers every resource.", "List the resources that are needed."),
    "PublicS3Bucket": ("Critical", "The bucket can be reached publicly.", "Block public access."),
    "UnencryptedS3Bucket": ("Medium", "The bucket has no encryption at rest.", "Turn on server-side encryption."),
    "OpenSecurityGroup": ("High", "The group is open to every address.", "Limit the addresses."),
    "OverlyPermissiveFirebaseRules": ("Critical", "The rules allow unrestricted access.", "Tie access to the signed-in user."),
    "MissingAuthenticationCheck": ("High", "The rules allow access without a signed-in user.", "Test request.auth."),
}


def first_quoted(config: Column, key: str) -> Column:
    """The value after `key =`, without quotes."""
    return F.nullif(F.regexp_extract(config, rf"{key}[^=\n]*=\s*[\"']?([^\"'\n]*)", 1), F.lit(""))


def arn(config: Column) -> Column:
    return F.nullif(F.regexp_extract(config, r"(arn:aws:[^\"'\n\s]*)", 1), F.lit(""))


def attributes(config: Column) -> dict[str, Column]:
    role = strip(first_quoted(config, "role"))
    return {"arn": arn(config), "region": strip(first_quoted(config, "region")), "runtime": strip(first_quoted(config, "runtime")), "handler": strip(first_quoted(config, "handler")), "role": F.nullif(F.regexp_extract(F.regexp_replace(role, r"\.(arn|id|name)$", ""), r"([^.]*)$", 1), F.lit(""))}


def finding(kind: Column, config: Column) -> Column:
    """The first finding that holds for an entity of this kind."""
    role = (kind == "iam_role") & config.contains("*") & config.contains("Effect") & config.contains("Allow")
    policy = kind == "iam_policy"
    bucket = kind == "s3_bucket"
    public = config.contains("public_access_block") & any_of(config, *[f"{k} = false" for k in ("block_public_acls", "block_public_policy", "ignore_public_acls", "restrict_public_buckets")])
    return first_case(
        [
            (role, "OverlyPermissiveAssumeRolePolicy"),
            (policy & any_of(config, '"Action": "*"', "Action: *"), "WildcardAction"),
            (policy & any_of(config, '"Resource": "*"', "Resource: *"), "WildcardResource"),
            (bucket & public, "PublicS3Bucket"),
            (bucket & ~any_of(config, "server_side_encryption", "encryption"), "UnencryptedS3Bucket"),
            ((kind == "security_group") & any_of(config, "0.0.0.0/0", "::/0"), "OpenSecurityGroup"),
        ]
    ).cast("string")


def block(lines: list[str], at: int, most: int = BLOCK_LINES) -> str:
    """Lines from `at` until its braces are balanced."""
    depth, out = 0, []
    for line in lines[at : at + most]:
        out.append(line)
        depth += line.count("{") - line.count("}")
        if depth <= 0 and "{" in "".join(out):
            break
    return "\n".join(out)


def terraform(files: DataFrame) -> DataFrame:
    """Resource blocks with balanced braces: the second quoted word is the name. Only files with such a resource reach the scanner."""
    used = files.where(ends_with_any(F.col("low_name"), ".tf", ".tf.json") & any_of(F.col("content"), *RESOURCES)).select("repository_id", "path", "content")

    def scanned(batches):
        import re

        import pandas as pd

        head = re.compile(r'resource\s+"(' + "|".join(RESOURCES) + r')"\s+"([^"]+)"')
        for pdf in batches:
            rows = []
            for repo, path, content in pdf.itertuples(index=False):
                lines = content.splitlines()
                for k, line in enumerate(lines):
                    if m := head.search(line):
                        rows.append((f"{path}:{k}:{m[2]}", repo, RESOURCES[m[1]], m[2], "aws", {"name": m[2]}, path, k + 1, f"arn:aws:s3:::{m[2]}" if m[1] == "aws_s3_bucket" else None, None, block(lines, k)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTITY_SCHEMA.replace("map<string,string>", "map").split(", ")])

    df = used.mapInPandas(scanned, ENTITY_SCHEMA)
    a = attributes(F.col("body"))
    more = F.map_filter(F.create_map(*[x for k in ("runtime", "handler", "role") for x in (F.lit(k), F.when(F.col("entity_type") == "lambda_function", a[k]))]), lambda k, v: v.isNotNull())
    return df.withColumns({"arn": F.coalesce("arn", a["arn"]), "region": a["region"], "configuration": F.map_concat("configuration", more)})


def parse_yaml(text: str):
    """Mappings, lists, scalars and block scalars of plain block YAML: what templates use. Flow style is read as JSON, tags are dropped."""
    import json
    import re

    rows, blocks, within = [], [], None
    for x in text.splitlines():
        indent, s = len(x) - len(x.lstrip()), x.strip()
        if within is not None:
            if not s or indent > within:
                blocks[-1].append(x)
                continue
            within = None
        if not s or s.startswith("#") or s in ("---", "..."):
            continue
        if m := re.search(r"(?:^|\s)(?:!\w+\s+)?[|>][-+\d]*(?:\s+#.*)?$", s):  # what is indented further is text
            within = indent + (len(s) - len(re.sub(r"^(?:-\s+)+", "", s)) if re.match(r"-\s+\S+:", s) else 0)
            blocks.append([])
            s = f"{s[: m.start()].rstrip()} \0{len(blocks) - 1}"
        rows.append((indent, s))

    def block_text(k: int) -> str:
        own = [len(x) - len(x.lstrip()) for x in blocks[k] if x.strip()]
        return "\n".join(x[min(own, default=0) :] for x in blocks[k]).rstrip("\n") + "\n" * bool(own)

    def scalar(s: str):
        s = re.sub(r"^!\w+\s*", "", s.strip())
        if s[:1] == "\0":
            return block_text(int(s[1:]))
        if s[:1] in "[{":
            try:
                return json.loads(s)
            except ValueError:
                return s
        return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s

    def node(i: int, indent: int):
        if i < len(rows) and rows[i][1].startswith("- "):
            out = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1].startswith("- "):
                rest = rows[i][1][2:]
                if re.match(r"^[^\"'\[{][^:]*:(\s|$)", rest):
                    rows[i] = (indent + 2, rest)
                    value, i = node(i, indent + 2)
                else:
                    value, i = scalar(rest), i + 1
                out.append(value)
            return out, i
        out = {}
        while i < len(rows) and rows[i][0] == indent:
            m = re.match(r"^(\"[^\"]*\"|'[^']*'|[^:]+|[^\s]+?):(?:\s+(.*))?$", rows[i][1]) or re.match(r"^(.*?):(?:\s+(.*))?$", rows[i][1])
            if not m:
                i += 1
                continue
            key, rest = scalar(m[1]), m[2]
            i += 1
            if rest:
                out[key] = scalar(rest)
            elif i < len(rows) and (rows[i][0] > indent or rows[i][0] == indent and rows[i][1].startswith("- ")):
                out[key], i = node(i, rows[i][0])
            else:
                out[key] = None
        return out, max(i, 0)

    out, i, merged = None, 0, {}
    while i < len(rows):
        was = i
        out, i = node(i, rows[i][0])
        if isinstance(out, dict):
            merged.update(out)
        i = max(i, was + 1)
    return merged or out


def parse_document(text: str):
    import json

    try:
        return json.loads(text)
    except ValueError:
        return parse_yaml(text)


def templates(files: DataFrame) -> DataFrame:
    """CloudFormation and SAM resources, and functions of serverless.yml: each once."""
    n, c = F.col("low_name"), F.col("content")
    cloud = ends_with_any(n, ".json", ".yaml", ".yml", ".template") & any_of(c, "AWSTemplateFormatVersion", "AWS::")
    used = files.where(cloud | n.rlike(r"^serverless\.ya?ml$")).select("repository_id", "path", "content", n.startswith("serverless.").alias("serverless"))

    def scanned(batches):
        import json

        import pandas as pd

        for pdf in batches:
            rows = []
            for repo, path, content, serverless in pdf.itertuples(index=False):
                doc = parse_document(content)
                doc = doc if isinstance(doc, dict) else {}
                for name, r in (doc.get("Resources") or {}).items() if isinstance(doc.get("Resources"), dict) else ():
                    kind = TEMPLATE_RESOURCES.get(r.get("Type")) if isinstance(r, dict) else None
                    if kind:
                        rows.append((f"{path}:{name}", repo, kind, name, "aws", {"resource_type": r["Type"]}, path, None, None, None, json.dumps(r)))
                listed = doc.get("functions") if serverless else None
                for name, f in listed.items() if isinstance(listed, dict) else ():
                    f = f if isinstance(f, dict) else {}
                    config = {"name": name} | {k: str(f[k]) for k in ("handler", "runtime") if f.get(k)}
                    rows.append((f"{path}:{name}", repo, "lambda_function", name, "aws", config, path, None, None, None, json.dumps(f)))
            yield pd.DataFrame(rows, columns=["id", "repository_id", "entity_type", "name", "provider", "configuration", "file_path", "line_number", "arn", "region", "body"])

    return used.mapInPandas(scanned, ENTITY_SCHEMA).dropDuplicates(["repository_id", "id"])


def _entity(kind: str, id_: Column, name: Column, provider: str, config: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in config.items() for x in (F.lit(k), v.cast("string"))]
    null = F.lit(None).cast("string")
    return [id_.alias("id"), F.col("repository_id"), F.lit(kind).alias("entity_type"), name.alias("name"), F.lit(provider).alias("provider"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("configuration"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line_number"), null.alias("arn"), null.alias("region"), F.col("content").alias("body")]


def preview(content: Column) -> Column:
    return F.when(F.length(content) > PREVIEW, F.concat(F.substring(content, 1, PREVIEW), F.lit("..."))).otherwise(content)


def rule_type(name: Column) -> Column:
    return first_case([(name.contains("firestore"), "Firestore rules"), (name.contains("storage"), "Storage rules"), (name.contains("database"), "Database rules")], "Firebase rules")


def firebase(files: DataFrame) -> DataFrame:
    n = F.col("low_name")
    used = files.where(n.endswith(".rules") | (n.contains("rules") & any_of(n, "firestore", "storage", "database", "firebase")))
    kind = rule_type(n)
    return used.select(*_entity("firebase_rules", F.concat("path", F.lit(":firebase:rules")), F.concat("file_name", F.lit(" ("), kind, F.lit(")")), "firebase", {"file_name": F.col("file_name"), "rule_type": kind, "content_preview": preview(F.col("content"))}))


def firebase_findings(entities: DataFrame) -> DataFrame:
    """Unrestricted access, and the first line that allows something without a signed-in user."""
    body = F.col("body")
    df = entities.where(F.col("entity_type") == "firebase_rules")
    open_ = any_of(body, "allow read, write: if true", "allow read, write;") | (body.contains("allow read, write") & body.contains("if true"))
    a = df.where(open_).select("*", F.lit("OverlyPermissiveFirebaseRules").alias("vulnerability_type"), F.lit(None).cast("int").alias("at"))
    bare = F.array_position(F.transform(F.split(body, "\n"), lambda x: any_of(x, "allow read", "allow write") & ~any_of(x, "request.auth", "if false")), True)
    b = df.withColumn("p", bare).where("p > 0").select(*df.columns, F.lit("MissingAuthenticationCheck").alias("vulnerability_type"), F.col("p").cast("int").alias("at"))
    return described(a.unionByName(b))


def described(df: DataFrame) -> DataFrame:
    """Vulnerability rows from entities with vulnerability_type and at."""
    told = F.create_map(*[x for k, v in RECOMMENDATIONS.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for n, y in zip(("severity", "description", "recommendation"), v, strict=True)]))])
    t = F.element_at(told, F.col("vulnerability_type"))
    return df.select(F.concat("id", F.lit(":vuln:"), "vulnerability_type").alias("id"), "repository_id", F.col("id").alias("entity_id"), "vulnerability_type", t["severity"].alias("severity"), t["description"].alias("description"), t["recommendation"].alias("recommendation"), "file_path", F.coalesce("at", "line_number").alias("line_number"))


def environment_templates(files: DataFrame, most: int = 20) -> DataFrame:
    used = files.where(F.col("low_name").startswith(".env") | ends_with_any(F.col("low_name"), ".env.example", ".env.template", "env.example"))
    bare = F.transform("lines", strip)
    names = F.transform(F.filter(bare, lambda x: (x != "") & ~x.startswith("#") & x.contains("=")), lambda x: strip(F.substring_index(x, "=", 1)))
    secret = F.exists(names, lambda n: any_of(F.lower(n), "secret", "key", "password", "token"))
    return used.select(*_entity("environment_config", F.concat("path", F.lit(":env:template")), F.col("file_name"), "generic", {"file_name": F.col("file_name"), "variable_count": F.size(names), "has_secrets": secret, "variables": F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, most), ","))}))


def security_configs(files: DataFrame) -> DataFrame:
    """JSON documents, or else YAML ones by their look, or else a preview."""
    n, c = F.col("low_name"), F.col("content")
    used = files.where(any_of(n, "security", "auth-config", "iam") & ends_with_any(n, ".json", ".yaml", ".yml", ".toml", ".conf", ".config"))
    is_json, is_yaml = F.try_parse_json(c).isNotNull(), ends_with_any(n, ".yaml", ".yml")
    config = {"file_name": F.col("file_name"), "config_type": first_case([(is_json, "json"), (is_yaml, "yaml")]).cast("string"), "content": F.when(is_json | is_yaml, c), "content_preview": F.when(~is_json & ~is_yaml, preview(c))}
    return used.select(*_entity("security_config", F.concat("path", F.lit(":security:config")), F.col("file_name"), "generic", config))


def detect_security(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relationships and vulnerabilities."""
    used = files.where(~skipped_by_security())
    tf = terraform(used)
    parts = [tf, templates(used), firebase(used), environment_templates(used), security_configs(used)]
    entities = parts[0]
    for p in parts[1:]:
        entities = entities.unionByName(p)
    roles = tf.where(F.col("entity_type") == "iam_role").select("repository_id", F.col("name").alias("role"), F.col("id").alias("target_entity_id"))
    functions = tf.where(F.col("entity_type") == "lambda_function").select("repository_id", F.col("id").alias("source_entity_id"), F.try_element_at("configuration", F.lit("role")).alias("role"))
    relationships = functions.join(roles, ["repository_id", "role"]).select("repository_id", "source_entity_id", "target_entity_id", F.lit("uses").alias("relationship_type"), F.array(F.lit("assume_role")).alias("permissions"), F.lit(None).cast("string").alias("condition"))
    found = tf.withColumn("vulnerability_type", finding(F.col("entity_type"), F.col("body"))).where(F.col("vulnerability_type").isNotNull()).withColumn("at", F.col("line_number"))
    return entities.drop("body"), relationships, described(found).unionByName(firebase_findings(entities))
