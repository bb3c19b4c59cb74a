"""Column expressions of the text scan: lines, tokens, entropy, known false positives, inline suppressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, patterns and severities that findings must carry. Classes are spelled out, as
# engines differ in what \d and \s hold.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}", "critical"),
    ("AWS Secret Key", r"(?i)aws_secret_access_key[ \t]*=[ \t]*[a-zA-Z0-9/+=]{40}", "critical"),
    ("Azure Storage Connection String", r"DefaultEndpointsProtocol=(?:http|https);AccountName=[^;\n]+;AccountKey=[A-Za-z0-9+/]{86}==", "critical"),
    ("Azure SAS Token", r"(?i)sv=20[0-9]{2}-[0-9]{2}-[0-9]{2}[^#\n]*[?&]sig=[A-Za-z0-9%+/]+=*", "high"),
    ("Google API Key", r"AIza[0-9A-Za-z\-_]{35}", "high"),
    ("GCP Service Account Key", r'"type"[ \t]*:[ \t]*"service_account"', "critical"),
    ("GCP OAuth2 Token", r"ya29\.[0-9A-Za-z\-_]+", "high"),
    ("DigitalOcean PAT", r"dop_v1_[a-zA-Z0-9]{64}", "high"),
    ("Alibaba Cloud Access Key ID", r"LTAI[A-Za-z0-9]{14,20}", "high"),
    ("GitHub PAT (classic)", r"ghp_[A-Za-z0-9]{36}", "critical"),
    ("GitHub PAT (fine-grained)", r"github_pat_[A-Za-z0-9_]{82}", "critical"),
    ("Slack Webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", "high"),
    ("Stripe Secret Key", r"sk_live_[0-9a-zA-Z]{24}", "critical"),
    ("Stripe Publishable Key", r"pk_live_[0-9a-zA-Z]{24}", "high"),
    ("SendGrid API Key", r"SG\.[a-zA-Z0-9\-_]{22}\.[a-zA-Z0-9\-_]{43}", "critical"),
    ("Mailgun API Key", r"key-[0-9a-zA-Z]{32}", "high"),
    ("Twilio Account SID", r"\bAC[a-f0-9]{32}\b", "high"),
    ("HashiCorp Vault Token", r"hvs\.[A-Za-z0-9_\-]{90,}", "critical"),
    ("Expo Access Token", r"expa_[A-Za-z0-9]{40,}", "high"),
    ("Sentry DSN", r"https://[a-f0-9]{16,32}@o[0-9]+\.ingest(?:\.us)?\.sentry\.io/[0-9]+", "medium"),
    ("Mapbox Secret Token", r"sk\.eyJ[A-Za-z0-9_\-]+", "high"),
    ("PEM Private Key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "critical"),
    ("JWT Token", r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", "high"),
    ("Generic PII (SSN)", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "low"),
    ("Generic PII (Email)", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "low"),
)
# What marks a value as documented, templated or a test key.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "yourkey", "dummy", "sample", "notreal", "redacted", "xxxxxx")
SAFE_PREFIXES = ("sk_test_", "pk_test_", "rk_test_")
# Shapes that are random but no secrets.
DIGEST_PREFIXES = ("sha1-", "sha256-", "sha384-", "sha512-", "md5-")
DIGEST_LENGTHS = (40, 64, 128)
DELIMITERS = "[=:\"' \\t,;]"
MIN_LENGTH, BASE64_BITS, HEX_BITS, HEX_LENGTH = 20, 4.5, 3.5, 32

#: The inline marker that suppresses a finding; a setting, as projects name it after their tool.
MARKER = "sievework: ignore"


def line_body(text: Column) -> Column:
    """A text whose line breaks are single characters, without the final one."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", "")


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row a line: key, line (from 1) and content, without the carriage return; a final line break opens no line."""
    rows = files.select(key, F.posexplode(F.split(line_body(F.col(text)), "\n", -1)).alias("at", "content"))
    return rows.select(key, (F.col("at") + 1).alias("line"), "content")


def false_positive(value: Column) -> Column:
    """Documented examples, templates and keys that are safe by construction; judged on the value, not its line."""
    low = F.lower(value)
    return reduce(lambda a, b: a | b, [low.startswith(p) for p in SAFE_PREFIXES] + [low.contains(m) for m in PLACEHOLDERS])


def tokens(line: Column) -> Column:
    return F.split(line, DELIMITERS, -1)


def entropy(token: Column) -> Column:
    """Shannon entropy in bits of the characters."""
    chars = F.split(token, "")
    n = F.length(token).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.length(token) > 0, bits).otherwise(F.lit(0.0))


def charset(token: Column) -> Column:
    return F.when(token.rlike("^[0-9a-fA-F]+$"), "hex").when(token.rlike("^[A-Za-z0-9+/=_-]+$"), "base64").otherwise("other")


def digest_shaped(token: Column, line: Column) -> Column:
    """Content hashes, integrity digests and data URIs."""
    low = F.lower(token)
    prefixed = reduce(lambda a, b: a | b, [low.startswith(p) for p in DIGEST_PREFIXES])
    return prefixed | (token.rlike("^[0-9a-fA-F]+$") & F.length(token).isin(*DIGEST_LENGTHS)) | line.contains("base64,")


def entropy_rule(token: Column, bits: Column) -> Column:
    """The entropy rule that a token trips, or null."""
    kind, n = charset(token), F.octet_length(token)
    return F.when(n < MIN_LENGTH, None).when((kind == "base64") & (bits > BASE64_BITS), "High Entropy String (base64)").when(
        (kind == "hex") & (bits > HEX_BITS) & (n >= HEX_LENGTH), "High Entropy String (hex)"
    )


def ignore_reason(line: Column, marker: str = MARKER) -> Column:
    """Null without the marker; else the reason given after it, perhaps ''."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.substr(line, F.instr(line, marker) + F.lit(len(marker)))), r"(\*/)+$", ""), r"(-->)+$", ""))
    quoted = F.regexp_extract(rest, r"""^reason=(["'])(.*?)(\1|$)""", 2)
    reason = F.when(rest.rlike("""^reason=["']"""), quoted).when(rest.startswith("reason="), F.substr(rest, F.lit(8))).otherwise(F.regexp_replace(rest, "^[—–: -]+", ""))
    return F.when(line.contains(marker), F.trim(reason))


def standalone(line: Column, marker: str = MARKER) -> Column:
    """A comment line that holds the marker alone covers the line after it."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), "^(//)+", ""), "^#+", ""), r"^(/\*)+", ""), "^(<!--)+", ""))
    return bare.startswith(marker)
