"""Secrets in strings: a pattern and enough entropy, less what is known to be harmless.

The thresholds are this engine's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.text import entropy

#: Fixed values: (rule, pattern of the secret, least entropy in bits a character).
PATTERNS = (
    ("SECRET_AWS_KEY", r"(AKIA[0-9A-Z]{16})", 3.0),
    ("SECRET_GOOGLE_API_KEY", r"(AIza[0-9A-Za-z_\-]{35})", 3.0),
    ("SECRET_PRIVATE_KEY_HEADER", r"(-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----)", 0.0),
    ("SECRET_JWT", r"(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})", 3.0),
    ("SECRET_STRIPE_KEY", r"([sr]k_live_[0-9A-Za-z]{16,})", 3.0),
    ("SECRET_SLACK_TOKEN", r"(xox[abprs]-[0-9A-Za-z\-]{10,})", 3.0),
    ("SECRET_GITHUB_PAT", r"(gh[pousr]_[0-9A-Za-z]{36,})", 3.0),
    ("SECRET_DB_CONN_STRING", r"((mongodb|postgres|postgresql|mysql|redis)://[^:@/\s]+:[^@/\s]+@[^\s\"']+)", 2.5),
    ("SECRET_GENERIC_API_KEY", r"(?i)(?:api_?key|secret|token|passwd|password) ?[=:] ?\"([0-9A-Za-z_\-]{16,})\"", 3.0),
    ("HIGH_ENTROPY_HEX", r"^([0-9a-f]{32})$", 3.0),
)
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def secrets(strings: DataFrame) -> DataFrame:
    """strings (.., value) with (rule_id, matched, entropy) of every pattern's first match with enough entropy.

    UUIDs, bare 40-digit hashes and numbers are none. Null and short values have no match.
    """
    value = F.col("value")
    harmless = value.rlike(UUID) | value.rlike("^[0-9a-f]{40}$") | value.rlike(r"^\d+$")
    hits = F.array(*(F.when(value.rlike(p), F.struct(F.lit(r).alias("rule_id"), F.regexp_extract(value, p, 1).alias("matched"), F.lit(e).alias("least"))) for r, p, e in PATTERNS))
    rows = strings.where(~harmless).withColumn("_hit", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    found = rows.select(*strings.columns, "_hit.rule_id", "_hit.matched", F.round(entropy(F.col("_hit.matched")), 6).alias("entropy"), "_hit.least")
    return found.where("entropy >= least").drop("least")
