"""Detection rules: built-in fixed values, rule files read by Spark, and plugin files merged into them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Wording and ranks of the rules, in order; the first that fits a line decides where one does.
ENV = (
    ("CLERK", "Clerk", "Auth"), ("AUTH0", "Auth0", "Auth"), ("STRIPE", "Stripe", "Payment"), ("TWILIO", "Twilio", "Api"), ("SENDGRID", "SendGrid", "Api"), ("MAILGUN", "Mailgun", "Api"),
    ("SLACK", "Slack", "Api"), ("DISCORD", "Discord", "Api"), ("DATADOG", "Datadog", "Monitoring"), ("NEW_RELIC", "NewRelic", "Monitoring"), ("SENTRY", "Sentry", "Monitoring"), ("LOGROCKET", "LogRocket", "Monitoring"),
    ("VERCEL", "Vercel", "CloudProvider"), ("NETLIFY", "Netlify", "CloudProvider"), ("CLOUDFLARE", "Cloudflare", "Cdn"), ("OPENAI", "OpenAI", "AI"), ("ANTHROPIC", "Anthropic", "AI"), ("GITHUB_COPILOT", "GitHubCopilot", "AI"),
    ("GOOGLE_AI", "GoogleAI", "AI"), ("GEMINI", "GoogleAI", "AI"), ("COHERE", "Cohere", "AI"), ("HUGGINGFACE", "HuggingFace", "AI"), ("HF_", "HuggingFace", "AI"), ("REPLICATE", "Replicate", "AI"),
    ("TOGETHER", "TogetherAI", "AI"), ("TOGETHER_AI", "TogetherAI", "AI"), ("MISTRAL", "MistralAI", "AI"), ("PERPLEXITY", "Perplexity", "AI"),
)
SDK = (
    ("@clerk/", "Clerk", "Auth"), ("@auth0/", "Auth0", "Auth"), ("stripe", "Stripe", "Payment"), ("twilio", "Twilio", "Api"), ("@sendgrid/", "SendGrid", "Api"), ("@slack/", "Slack", "Api"),
    ("discord.js", "Discord", "Api"), ("@datadog/", "Datadog", "Monitoring"), ("@sentry/", "Sentry", "Monitoring"), ("@vercel/", "Vercel", "CloudProvider"), ("openai", "OpenAI", "AI"), ("@openai/", "OpenAI", "AI"),
    ("anthropic", "Anthropic", "AI"), ("@anthropic-ai/", "Anthropic", "AI"), ("@anthropic-ai/sdk", "Anthropic", "AI"), ("github-copilot", "GitHubCopilot", "AI"), ("@copilot/", "GitHubCopilot", "AI"),
    ("@google/generative-ai", "GoogleAI", "AI"), ("@google-ai/generativelanguage", "GoogleAI", "AI"), ("google-generativeai", "GoogleAI", "AI"), ("cohere", "Cohere", "AI"), ("@cohere-ai/", "Cohere", "AI"),
    ("huggingface", "HuggingFace", "AI"), ("@huggingface/", "HuggingFace", "AI"), ("transformers", "HuggingFace", "AI"), ("replicate", "Replicate", "AI"), ("together", "TogetherAI", "AI"), ("@together-ai/", "TogetherAI", "AI"),
    ("mistralai", "MistralAI", "AI"), ("@mistralai/", "MistralAI", "AI"), ("perplexity", "Perplexity", "AI"), ("@perplexity/", "Perplexity", "AI"),
)
API = (
    ("api.github.com", "GitHub", "Api"), ("api.gitlab.com", "GitLab", "Api"), ("api.linear.app", "Linear", "Api"), ("api.atlassian.com", "Jira", "Api"), ("api.openai.com", "OpenAI", "AI"), ("api.anthropic.com", "Anthropic", "AI"),
    ("api.cohere.ai", "Cohere", "AI"), ("api-inference.huggingface.co", "HuggingFace", "AI"), ("api.replicate.com", "Replicate", "AI"), ("api.together.xyz", "TogetherAI", "AI"), ("api.mistral.ai", "MistralAI", "AI"),
    ("api.perplexity.ai", "Perplexity", "AI"), ("generativelanguage.googleapis.com", "GoogleAI", "AI"), ("generativeai.googleapis.com", "GoogleAI", "AI"),
)
DATABASE = (("postgresql://", "Postgres"), ("postgres://", "Postgres"), ("mysql://", "MySQL"), ("mongodb://", "MongoDB"), ("redis://", "Redis"), ("dynamodb", "DynamoDB"))
INFRASTRUCTURE = (
    ("aws_s3_bucket", "Aws", "CloudProvider", "S3"), ("aws_lambda", "Aws", "CloudProvider", "Lambda"), ("aws_iam", "Aws", "CloudProvider", "IAM"), ("aws_dynamodb", "DynamoDB", "Database", "DynamoDB"),
    ("aws_rds", "RDS", "Database", "RDS"), ("aws_ec2", "Aws", "CloudProvider", "EC2"), ("aws_ecs", "Aws", "CloudProvider", "ECS"), ("aws_cloudfront", "CloudFront", "Cdn", "CloudFront"),
    ("aws_sns", "Aws", "CloudProvider", "SNS"), ("aws_sqs", "Aws", "CloudProvider", "SQS"), ("aws_api_gateway", "Aws", "CloudProvider", "API Gateway"), ("aws_cognito", "Aws", "Auth", "Cognito"),
)
AWS_NAMES = {
    "s3": "S3", "dynamodb": "DynamoDB", "lambda": "Lambda", "sns": "SNS", "sqs": "SQS", "ses": "SES", "ec2": "EC2", "rds": "RDS", "cloudfront": "CloudFront", "cognito": "Cognito", "cognito-identity-provider": "Cognito",
    "iam": "IAM", "sts": "STS", "cloudwatch": "CloudWatch", "kms": "KMS", "secrets-manager": "Secrets Manager", "ssm": "Systems Manager", "apigateway": "API Gateway", "apigatewayv2": "API Gateway v2",
    "eventbridge": "EventBridge", "stepfunctions": "Step Functions", "s3-control": "S3 Control", "s3-outposts": "S3 Outposts", "textract": "Textract", "comprehend": "Comprehend", "translate": "Translate",
    "polly": "Polly", "rekognition": "Rekognition", "transcribe": "Transcribe", "bedrock": "Bedrock", "bedrock-runtime": "Bedrock Runtime",
}
#: SDK v2 has the first twelve and some more, under names without hyphens.
AWS_V2 = ("s3", "dynamodb", "lambda", "sns", "sqs", "ses", "ec2", "rds", "cloudfront", "cognito", "iam", "sts", "cloudwatch", "kms", "secretsmanager", "ssm", "apigateway", "eventbridge", "stepfunctions")

DEFAULT_CONFIDENCE = 0.7
FAMILIES = {"env": "environment_variables", "sdk": "sdk_patterns", "api": "api_endpoints", "database": "database_patterns", "infrastructure": "aws_infrastructure", "aws_v2": "aws_sdk_v2_services"}


@dataclass(frozen=True)
class Rule:
    pattern: str
    provider: str = "Unknown"
    service_type: str = "Other"
    confidence: float = DEFAULT_CONFIDENCE
    service_name: str | None = None


@dataclass(frozen=True)
class Rules:
    env: tuple[Rule, ...] = ()
    sdk: tuple[Rule, ...] = ()
    api: tuple[Rule, ...] = ()
    database: tuple[Rule, ...] = ()
    infrastructure: tuple[Rule, ...] = ()
    aws_v2: tuple[Rule, ...] = ()
    aws_names: dict[str, str] = field(default_factory=dict)

    def merged(self, other: Rules) -> Rules:
        """Lists are put after one another; names of the other overwrite."""
        return replace(self, **{f: getattr(self, f) + getattr(other, f) for f in FAMILIES}, aws_names=self.aws_names | other.aws_names)


def builtin() -> Rules:
    v2 = tuple(Rule(p, "Aws", "CloudProvider", 0.85, {"secretsmanager": "Secrets Manager"}.get(p) or AWS_NAMES[p]) for p in AWS_V2)
    return Rules(
        tuple(Rule(*x, 0.7) for x in ENV),
        tuple(Rule(*x, 0.8) for x in SDK),
        tuple(Rule(*x, 0.7) for x in API),
        tuple(Rule(p, v, "Database", 0.9) for p, v in DATABASE),
        tuple(Rule(p, v, t, 0.8, n) for p, v, t, n in INFRASTRUCTURE),
        v2,
        dict(AWS_NAMES),
    )


def read_rules(spark: SparkSession, *paths: str, base: Rules | None = None) -> tuple[Rules, list[str]]:
    """base (the built-in rules) with those of the files merged in order, and the paths whose file is no rule file.

    Rule files are small JSON documents; Spark reads them, so they may lie in any store.
    """
    one = "struct<pattern:string,provider:string,service_type:string,confidence:double,service_name:string,display_name:string>"
    schema = f"patterns struct<{', '.join(f'{n}:array<{one}>' for n in FAMILIES.values())}, aws_sdk_v3_service_map:map<string,string>>"
    rules, bad = base or builtin(), []
    for path in paths:
        raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema)["patterns"].alias("p")).first()
        if raw is None or raw["p"] is None:
            bad.append(path)
            continue
        p = raw["p"].asDict()
        found = {f: tuple(Rule(r["pattern"], r["provider"] or "Unknown", r["service_type"] or "Other", r["confidence"] or DEFAULT_CONFIDENCE, r["service_name"] or r["display_name"]) for r in p[n] or () if r["pattern"]) for f, n in FAMILIES.items()}
        rules = rules.merged(Rules(**found, aws_names=p["aws_sdk_v3_service_map"] or {}))
    return rules, bad
