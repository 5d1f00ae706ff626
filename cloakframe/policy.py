"""What to look for, what to leave alone and how to rewrite: one immutable value per run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from cloakframe.functions import patterns

# Words that a name/organisation/place finding may not consist of.
FALSE_POSITIVE_WORDS: tuple[str, ...] = (
    "upload", "download", "sync", "backup", "update", "install", "login", "logout", "signup", "signin", "reset",
    "refresh",
    "credit", "debit", "account", "balance", "payment", "invoice", "service", "support", "sales", "billing",
    "admin", "system", "customer", "client", "user", "member",
    "modem", "router", "gateway", "nbn", "handset", "sim",
    "speed", "ping", "latency", "bandwidth", "upstream", "downstream", "mbps", "kbps", "gbps",
    "telstra", "console", "mica", "bill", "siebel", "flexcab", "debitors", "pega", "braintree", "salesforce",
    "nsw", "vic", "qld", "wa", "sa", "tas", "act", "nt",
    "aest", "aedt", "acst", "acdt", "awst", "awdt",
    "medicare", "centrelink", "driver", "license", "licence",
    "tio", "acma",
    "bpay", "paypal",
    "escalated", "provisioning", "activated", "cancelled", "canceled", "retention", "winback", "churn",
    "dob", "eta", "asap", "tba", "tbd", "fyi", "pm", "am",
    "cx", "cust", "otc", "cac",
    "fttn", "fttp", "fttc", "fttb", "hfc", "adsl", "vdsl",
    "action", "flow", "guided", "additional", "assistance", "retain",
    "y/n", "y", "n", "yes", "no",
)

# Finding types that are never reported.
SKIPPED_TYPES: tuple[str, ...] = ("DATE_TIME", "CARDINAL", "ORDINAL", "QUANTITY", "MONEY")

STRATEGIES = ("redact", "mask", "replace", "hash")


@dataclass(frozen=True)
class Redact:
    token: str = "[REDACTED]"
    type_specific: bool = True


@dataclass(frozen=True)
class Mask:
    mask_char: str = "*"
    email_visible_chars: int = 1
    phone_visible_chars: int = 3
    ssn_visible_chars: int = 4
    credit_card_visible_chars: int = 4
    #: Mask AU_PHONE_NUMBER like other phones instead of like any value.
    au_phones: bool = False


@dataclass(frozen=True)
class Hash:
    algorithm: str = "sha256"
    prefix: bool = True
    salt: str = "default_salt_change_in_production"
    truncate: int = 8


@dataclass(frozen=True)
class Replace:
    seed: str = ""
    preserve_format: bool = True
    available: bool = True


@dataclass(frozen=True)
class Policy:
    """``entities`` of None means every entity that is on by default."""

    entities: tuple[str, ...] | None = None
    threshold: float = 0.5
    skipped_types: tuple[str, ...] = SKIPPED_TYPES
    false_positive_words: tuple[str, ...] = FALSE_POSITIVE_WORDS
    apply_lists: bool = True
    allow_values: tuple[str, ...] = ("noreply@example.com", "support@company.com")
    allow_domains: tuple[str, ...] = ("example.com", "localhost")
    allow_patterns: tuple[str, ...] = ()
    deny_values: tuple[str, ...] = ("test@test.com", "123-45-6789")
    strategy: str = "redact"
    redact: Redact = field(default_factory=Redact)
    mask: Mask = field(default_factory=Mask)
    hash: Hash = field(default_factory=Hash)
    replace_with: Replace = field(default_factory=Replace)
    #: A longer text fails instead of being analysed; None for no limit.
    max_chars: int | None = None

    def __post_init__(self):
        unknown = [t for t in self.entities or () if t not in registered_entities()]
        if unknown:
            raise ValueError(f"unknown entities: {unknown}")
        if self.hash.algorithm not in ("md5", "sha1", "sha256"):
            raise ValueError(f"unsupported hash algorithm: {self.hash.algorithm}")

    def but(self, **changes) -> "Policy":
        return replace(self, **changes)

    def selected(self) -> tuple[patterns.Entity, ...]:
        table = registered_entities()
        if self.entities is None:
            return tuple(e for e in table.values() if e.on_by_default)
        return tuple(e for e in table.values() if e.pii_type in self.entities)


_EXTRA: dict[str, patterns.Entity] = {}


def registered_entities() -> dict[str, patterns.Entity]:
    return {**patterns.BY_TYPE, **_EXTRA}


def register_patterns(pii_type: str, shapes, context=(), check: patterns.Check = None) -> None:
    """Adds an entity: ``shapes`` is a list of (name, regex, score) or of Shape.  ``check`` judges a match like check
    digits do: the name of a built-in rule, or a function from the value column to a boolean column; true makes the
    match certain, false drops it, null leaves its score."""
    built = tuple(s if isinstance(s, patterns.Shape) else patterns.Shape(*s) for s in shapes)
    _EXTRA[pii_type] = patterns.Entity(pii_type, built, tuple(context), check)


def unregister_patterns(pii_type: str) -> None:
    _EXTRA.pop(pii_type, None)
