"""Rule packs. Importing this package registers the built-in ones."""

from codesieve.rules import core, light  # noqa: F401
from codesieve.rules.registry import (
    CATEGORIES, DIALECTS, PROFILES, Rule, has, has_any_case, matches, register, rules, unregister,
)

__all__ = [
    "CATEGORIES", "DIALECTS", "PROFILES", "Rule", "has", "has_any_case", "matches", "register", "rules", "unregister",
]
