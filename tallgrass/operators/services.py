"""External services: which files are looked at and as what, what package names suggest, and the merged table; the rules themselves are found by `rule_scan`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import any_of, ends_with_any, first_case, stable_id
from tallgrass.operators.aggregates import merged_services
from tallgrass.operators.rule_scan import rule_hits
from tallgrass.sources.corpus import skipped_by_services
from tallgrass.sources.rules import Rules, builtin

CODE_ENDS = (".js", ".ts", ".jsx", ".tsx", ".py", ".rs", ".go", ".swift", ".m", ".mm", ".java")
# Package name parts by manager, the first that is held decides.
PACKAGES = {
    "npm": (("@vercel/", "Vercel", "CloudProvider"), ("@netlify/", "Netlify", "CloudProvider"), ("@aws/", "AWS", "CloudProvider"), ("@azure/", "Azure", "CloudProvider"), ("@google-cloud/", "GCP", "CloudProvider"), ("@clerk/", "Clerk", "Auth"), ("@auth0/", "Auth0", "Auth"), ("passport-", "Auth", "Auth"), ("stripe", "Stripe", "Payment"), ("paypal", "PayPal", "Payment"), ("@datadog/", "Datadog", "Monitoring"), ("@sentry/", "Sentry", "Monitoring"), ("@newrelic/", "NewRelic", "Monitoring"), ("openai", "OpenAI", "AI"), ("@openai/", "OpenAI", "AI"), ("anthropic", "Anthropic", "AI"), ("@anthropic-ai/", "Anthropic", "AI"), ("@google/generative-ai", "GoogleAI", "AI"), ("cohere", "Cohere", "AI"), ("@huggingface/", "HuggingFace", "AI"), ("twilio", "Twilio", "Api"), ("@sendgrid/", "SendGrid", "Api"), ("@slack/", "Slack", "Api"), ("discord.js", "Discord", "Api")),
    "pip": (("boto3", "AWS", "CloudProvider"), ("google-cloud-", "GCP", "CloudProvider"), ("azure-", "Azure", "CloudProvider"), ("stripe", "Stripe", "Payment"), ("twilio", "Twilio", "Api"), ("sendgrid", "SendGrid", "Api"), ("slack-sdk", "Slack", "Api"), ("discord.py", "Discord", "Api"), ("openai", "OpenAI", "AI"), ("anthropic", "Anthropic", "AI"), ("cohere", "Cohere", "AI"), ("datadog", "Datadog", "Monitoring"), ("sentry-sdk", "Sentry", "Monitoring")),
    "cargo": (("aws-sdk", "AWS", "CloudProvider"), ("rusoto", "AWS", "CloudProvider"), ("google-cloud", "GCP", "CloudProvider"), ("azure", "Azure", "CloudProvider"), ("stripe", "Stripe", "Payment"), ("twilio", "Twilio", "Api"), ("sentry", "Sentry", "Monitoring")),
    "go": (("github.com/aws/aws-sdk-go", "AWS", "CloudProvider"), ("cloud.google.com/go", "GCP", "CloudProvider"), ("github.com/stripe/", "Stripe", "Payment"), ("github.com/twilio/", "Twilio", "Api"), ("github.com/slack-go/", "Slack", "Api"), ("github.com/bwmarrin/discordgo", "Discord", "Api")),
}
SERVICE_WORDS = ("-sdk", "-client", "-api", "-service", "sdk-", "client-", "api-", "service-")


def file_class(low_name: Column) -> Column:
    return first_case(
        [
            (any_of(low_name, "terraform", "cloudformation") | ends_with_any(low_name, ".tf", ".tfvars"), "infrastructure"),
            (ends_with_any(low_name, ".json", ".yaml", ".yml", ".toml", ".env") | low_name.contains("config"), "config"),
            (ends_with_any(low_name, *CODE_ENDS), "code"),
        ]
    ).cast("string")


def package_services(dependencies: DataFrame) -> DataFrame:
    """Services that package names suggest: known parts (0.6), and for npm names that look like a client (0.4)."""
    low = F.lower("name")
    known = first_case([((F.col("package_manager") == m) & low.contains(p), F.struct(F.lit(v).alias("provider"), F.lit(t).alias("service_type"))) for m, ps in PACKAGES.items() for p, v, t in ps], F.lit(None).cast("struct<provider:string,service_type:string>"))
    a = dependencies.withColumn("k", known).where(F.col("k").isNotNull()).select("repository_id", "file_path", "k.provider", "k.service_type", "name", F.lit(None).cast("int").alias("line_number"), F.lit(0.6).alias("confidence"))
    guess = low
    for w in SERVICE_WORDS:
        guess = F.replace(guess, F.lit(w), F.lit(""))
    guess = F.regexp_replace(F.regexp_replace(guess, "^@", ""), "/.*$", "")
    b = dependencies.where((F.col("package_manager") == "npm") & any_of(low, *SERVICE_WORDS)).select("repository_id", "file_path", F.when(guess != "", F.initcap(guess)).otherwise(F.lit("Unknown")).alias("provider"), F.lit("Other").alias("service_type"), "name", F.lit(None).cast("int").alias("line_number"), F.lit(0.4).alias("confidence"))
    return a.unionByName(b)


def detect_services(files: DataFrame, dependencies: DataFrame | None = None, rules: Rules | None = None) -> DataFrame:
    """Rows of the services table, merged by name, provider and type."""
    rules = rules or builtin()
    df = files.where(~skipped_by_services() | F.col("low_name").startswith(".env")).withColumn("class", file_class(F.col("low_name"))).where(F.col("class").isNotNull())
    rows = rule_hits(df, rules).drop("family")
    if dependencies is not None:
        rows = rows.unionByName(package_services(dependencies))
    place = F.concat_ws("\u0001", "file_path", F.lpad(F.coalesce(F.col("line_number").cast("string"), F.lit("0")), 9, "0"), "name")
    return merged_services(rows.withColumn("ord_key", place).withColumn("ord", F.xxhash64("ord_key")).withColumn("id", stable_id(F.lit("service"), F.col("repository_id"), F.col("ord_key"))))
