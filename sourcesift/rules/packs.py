"""The pack registry: name -> rules. Users add their own packs with ``register_pack``."""

from __future__ import annotations

from sourcesift.rules import extended as x
from sourcesift.rules.credentials import CREDENTIALS
from sourcesift.rules.model import Rule
from sourcesift.rules.security import SECURITY

PACKS: dict[str, list[Rule]] = {
    "credentials": CREDENTIALS,
    "security": SECURITY,
    "dynamic_code": x.DYNAMIC_CODE,
    "business_logic": x.BUSINESS_LOGIC,
    "websocket": x.WEBSOCKET,
    "crypto_context": x.CRYPTO_CONTEXT,
    "info_leakage": x.INFO_LEAKAGE,
    "idor": x.IDOR,
    "web3": x.WEB3,
    "config_flags": x.CONFIG_FLAGS,
    "lazy_loading": x.LAZY_LOADING,
    "modern_crypto": x.MODERN_CRYPTO,
}
# The two packs that the fast mode keeps.
FAST_PACKS = ("credentials", "security")


def register_pack(name: str, rules: list[Rule]) -> None:
    PACKS[name] = list(rules)
