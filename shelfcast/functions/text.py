"""Text expressions for keys and for the credential check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRODUCT_CODE = "^[0-9]{5}[A-Z]{0,2}$"

# What counts as a credential in published text, and the plain text
# that any match must contain.
CREDENTIAL_PATTERNS = {
    "gh[pousr]_[A-Za-z0-9]{30,}": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "github_pat_[A-Za-z0-9_]{60,}": ["github_pat_"],
    "sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,}": ["sk-"],
    "(?:AKIA|ASIA)[A-Z0-9]{16}": ["AKIA", "ASIA"],
    "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----": ["PRIVATE KEY-----"],
}


# ASCII white space.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalized_code(text: Column) -> Column:
    return F.upper(strip(text))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")
