"""What to do about findings: allow, warn or block, and value-free incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.operators.config import ScanConfig

# What types are called in messages.
LABELS = {
    "aws_access_key": "AWS access key", "aws_secret_key": "AWS secret key", "aws_bedrock_key": "AWS Bedrock API key", "gcp_api_key": "GCP API key",
    "gcp_service_account": "GCP service account key", "azure_token": "Azure token", "digitalocean_token": "DigitalOcean token", "heroku_key": "Heroku API key",
    "flyio_token": "Fly.io token", "cloudflare_key": "Cloudflare key", "doppler_token": "Doppler token", "databricks_token": "Databricks token",
    "vault_token": "Vault token", "pulumi_token": "Pulumi token", "hashicorp_token": "HashiCorp token", "dynatrace_token": "Dynatrace token",
    "github_token": "GitHub token", "gitlab_token": "GitLab token", "slack_token": "Slack token", "atlassian_token": "Atlassian token",
    "linear_token": "Linear token", "notion_token": "Notion token", "okta_token": "Okta token", "stripe_key": "Stripe key", "square_token": "Square token",
    "openai_key": "OpenAI key", "anthropic_key": "Anthropic key", "huggingface_token": "Hugging Face token", "cohere_token": "Cohere token",
    "sendgrid_key": "SendGrid key", "shopify_token": "Shopify token", "npm_token": "npm token", "pypi_token": "PyPI token", "postman_token": "Postman token",
    "planetscale_token": "PlanetScale token", "new_relic_key": "New Relic key", "sentry_token": "Sentry token", "grafana_token": "Grafana token",
    "twilio_key": "Twilio key", "artifactory_key": "Artifactory key", "mailchimp_token": "Mailchimp token", "dropbox_token": "Dropbox token",
    "airtable_token": "Airtable token", "jwt": "JWT", "oauth_bearer": "OAuth bearer token", "private_key": "private key", "database_url": "database URL",
    "generic_api_key": "API key", "high_entropy_string": "high-entropy string", "env_assignment": "credential assignment",
    "credit_card": "credit card number", "ssn": "US Social Security number", "custom": "custom sensitive value",
}


def action_of(finding: Column, config: ScanConfig) -> Column:
    """Block sure findings of rules that may block, unless they stand in a development context; else warn."""
    rules = [r.id for r in (config.every_rule() if config.honour_custom_block else config.rules) if r.block]
    return F.when((finding["confidence"] == "high") & finding["rule_id"].isin(*rules) & (finding["environment"] != "dev"), "block").otherwise("warn")


def label(kind: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, kind), F.replace(kind, F.lit("_"), F.lit(" ")))


def decide(scanned: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """`scanned` (id, findings) with per_finding, action and summary."""
    config = config or ScanConfig()
    rows = scanned.withColumn("per_finding", F.transform("findings", lambda f: action_of(f, config)))
    count = lambda what: F.size(F.filter("per_finding", lambda a: a == what))
    blocked, warned = count("block"), count("warn")
    rows = rows.withColumn("action", F.when(blocked > 0, "block").when(warned > 0, "warn").otherwise("allow"))
    lead = F.element_at("findings", F.greatest(F.array_position("per_finding", F.col("action")), F.lit(1)).cast("int"))["type"]
    more = blocked + warned - 1
    block_text = F.concat(F.lit("Blocked: "), label(lead), F.lit(" detected"), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")), F.lit("."))
    warn_text = F.when(warned == 1, F.concat(F.lit("Warning: possible "), label(lead), F.lit(" detected."))).otherwise(F.concat(F.lit("Warning: "), warned.cast("string"), F.lit(" possible secrets detected.")))
    summary = F.when(blocked > 0, block_text).when(warned > 0, warn_text).otherwise(F.lit("No secrets detected."))
    return rows.withColumn("summary", summary)


def decide_all(texts: DataFrame, scanned: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """`decide` for every row of `texts` (id): those without findings have an empty list and are allowed."""
    rows = texts.select("id").join(scanned.select(F.col("id").alias("of"), "findings"), F.col("id").eqNullSafe(F.col("of")), "left").drop("of")
    none = F.array().cast(scanned.schema["findings"].dataType)
    return decide(rows.withColumn("findings", F.coalesce("findings", none)), config)


def already_safe(findings: Column, mocks: Column) -> Column:
    """Whether all that a text holds are stand-ins that are known, so that it may go as it is; true without findings."""
    known = F.coalesce(mocks, F.array().cast("array<string>"))
    return F.coalesce(F.forall(findings, lambda f: F.coalesce(F.array_contains(known, f["value"]), F.lit(False))), F.lit(True))


def incidents(decided: DataFrame, tool: str, timestamp: Column | None = None) -> DataFrame:
    """One row a finding that isn't allowed, without the value or the text."""
    rows = decided.select("id", F.explode(F.arrays_zip("findings", "per_finding")).alias("x")).where("x.per_finding <> 'allow'")
    f = F.col("x.findings")
    stamp = timestamp if timestamp is not None else F.current_timestamp()
    return rows.select("id", stamp.alias("timestamp"), F.lit(tool).alias("tool"), f["type"].alias("secret_type"), f["layer"].alias("layer"), f["confidence"].alias("confidence"), f["environment"].alias("environment"), F.col("x.per_finding").alias("action"), f["rule_id"].alias("rule_id"))


def incident_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("secret_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "block").alias("blocked"))


def retain_last(rows: DataFrame, partition: list[str], most: int = 500) -> DataFrame:
    """The newest `most` incidents of each partition (a site, a tool)."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("timestamp").desc(), F.col("id").desc()))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")
