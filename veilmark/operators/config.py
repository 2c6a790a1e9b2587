"""Settings of a scan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from veilmark.sources.rules import Rule, builtin_rules

# Words that suggest a credential nearby, environments, and text that is never a secret.
CONTEXT_WORDS = ["password", "passwd", "pwd", "secret", "token", "auth", "authorization", "credential", "credentials", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "client_secret", "bearer", "session", "cookie", "db", "database", "connection", "conn_str", "dsn"]
PROD_WORDS = ["prod", "production", "live", "release"]
DEV_WORDS = ["dev", "development", "staging", "stage", "test", "testing", "sandbox", "local", "localhost", "demo", "example", "sample", "mock", "dummy", "fake", "placeholder"]
ALLOWLIST = ["localhost", "127.0.0.1", "0.0.0.0", "example.com", "example.org", "example", "your-", "xxxx", "<your", "placeholder", "changeme", "change-me", "redacted", "dummy", "notreal", "foobar"]


@dataclass(frozen=True)
class ScanConfig:
    """What a caller may change; an own allowlist is added to the default one, never put in its place."""

    entropy_threshold: float = 4.0
    entropy_min_length: int = 20
    require_context_for_entropy: bool = True
    suppressed_rule_ids: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    context_window: int = 64
    custom_rules: tuple[Rule, ...] = ()
    honour_custom_block: bool = True
    marker: str = "VEILMARK_MOCK_"
    rules: tuple[Rule, ...] = field(default_factory=lambda: tuple(builtin_rules()))

    def allowed(self) -> list[str]:
        return [w.lower() for w in (*ALLOWLIST, *self.allowlist)]

    def every_rule(self) -> list[Rule]:
        return [*self.rules, *self.custom_rules]

    def having(self, **changes) -> ScanConfig:
        return replace(self, **changes)
