"""A project's settings: declared once, checked all at once, with every problem reported."""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from typing import Any
from zoneinfo import ZoneInfo

from ..operators.policies import PRIVACY_RANK

DATE_SOURCES = ("camera", "filename", "album", "upload")
RULE_KEYS = ("album", "make", "model", "filename")


def text(value: Any) -> str | None:
    return None if isinstance(value, str) else f"must be a string, got {type(value).__name__}"


def whole(least: int):
    """A number from `least` on; true and false are no numbers."""
    return lambda v: None if isinstance(v, int) and not isinstance(v, bool) and v >= least else f"must be a whole number of at least {least}, got {v!r}"


def one_of(*values: Any):
    return lambda v: None if any(v == x and isinstance(v, bool) == isinstance(x, bool) for x in values) else f"must be one of {list(values)}, got {v!r}"


def texts(value: Any) -> str | None:
    return None if isinstance(value, list) and all(isinstance(x, str) for x in value) else f"must be a list of strings, got {value!r}"


def template(needs: set[str], allows: set[str]):
    def check(value: Any) -> str | None:
        if not isinstance(value, str):
            return "must be a string"
        used = {name for _, name, _, _ in string.Formatter().parse(value) if name}
        if needs - used:
            return f"must contain {sorted(needs - used)}, got {value!r}"
        return f"has unknown placeholders {sorted(used - needs - allows)}" if used - needs - allows else None

    return check


def zone(value: Any) -> str | None:
    try:
        ZoneInfo(value)
    except (KeyError, ValueError, TypeError, OSError):
        return f"is not a known time zone: {value!r}"
    return None


def rules(value: Any) -> str | None:
    if not isinstance(value, list) or not all(isinstance(r, dict) for r in value):
        return "must be a list of tables"
    for n, rule in enumerate(value, 1):
        if set(rule) - {"name", *RULE_KEYS}:
            return f"rule {n} has unknown keys {sorted(set(rule) - {'name', *RULE_KEYS})}"
        if not rule.get("name") or not all(isinstance(x, str) for x in rule.values()):
            return f"rule {n} needs a name, and texts as values"
        if not set(rule) & set(RULE_KEYS):
            return f"rule {n} has no conditions"
    return None


@dataclass(frozen=True)
class Setting:
    default: Any
    check: Any


_ALBUM = template({"yyyy"}, {"mm", "group"})
_NAME = template({"yyyy", "subject"}, {"mm", "dd"})
#: The settings, their defaults and what they may be.
SETTINGS: dict[str, dict[str, Setting]] = {
    "project": {"name": Setting("", text), "timezone": Setting("UTC", zone)},
    "destination": {"folder": Setting("Consolidated", text)},
    "albums": {
        "photo": Setting("Photos {yyyy}-{mm}", _ALBUM),
        "video": Setting("Photos {yyyy}-{mm}", _ALBUM),
        "undated_photo": Setting("Photos Undated", text),
        "undated_video": Setting("Videos Undated", text),
        "duplicates": Setting("Duplicates (review)", text),
        "soft_cap": Setting(4000, whole(1)),
        "hard_cap": Setting(5000, whole(1)),
    },
    "import": {
        "heic": Setting("convert", one_of("convert", "keep")),
        "live_clips": Setting("pair", one_of("pair", "separate", "skip")),
        "unpaired_clips": Setting("dated", one_of("dated", "undated", "skip")),
        "rejected_types": Setting("skip", one_of("skip", "convert")),
        "dedupe": Setting("content", one_of("content", "exact", "off")),
        "existing": Setting(["/"], texts),
        "same_max": Setting(6, whole(1)),
        "different_min": Setting(19, whole(1)),
        "pair_window": Setting(60, whole(1)),
        "aspect_tolerance_pct": Setting(2, whole(1)),
    },
    "organize": {
        "sources": Setting([], texts),
        "dates": Setting(["camera", "filename", "album"], texts),
        "mode": Setting("move", one_of("move", "collect")),
        "skip_newer_than_days": Setting(0, whole(0)),
        "duplicates": Setting("park", one_of("park", "keep")),
        "unassigned": Setting("Unassigned", text),
        "group": Setting([], rules),
    },
    "naming": {
        "scope": Setting([], texts),
        "exclude": Setting([], texts),
        "month": Setting("{yyyy}-{mm} {subject}", _NAME),
        "year": Setting("{yyyy} {subject}", _NAME),
        "day": Setting("{yyyy}-{mm}-{dd} {subject}", _NAME),
        "keep_day": Setting(True, one_of(True, False)),
        "min_confidence": Setting("high", one_of("high", "medium")),
        "date_from_photos": Setting(True, one_of(True, False)),
        "photo_sample": Setting(60, whole(1)),
        "min_photos": Setting(5, whole(1)),
        "max_spread_days": Setting(45, whole(1)),
    },
}
#: What policies may set, as far as the library reads it; a destination may allow more.
POLICY_VALUES: dict[str, tuple] = {"downloads": (True, False), "privacy": tuple(PRIVACY_RANK)}


class SettingsError(ValueError):
    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("invalid settings:\n" + "\n".join(f"  - {p}" for p in problems))


@dataclass(frozen=True)
class Settings:
    values: dict[str, dict[str, Any]] = field(default_factory=dict)
    policies: list[dict] = field(default_factory=list)

    def get(self, section: str, key: str) -> Any:
        return self.values[section][key]


def problems_of_policies(policies: Any, allowed: dict[str, tuple]) -> list[str]:
    if not isinstance(policies, list) or not all(isinstance(p, dict) for p in policies):
        return ["policies must be a list of tables"]
    found = []
    for n, policy in enumerate(policies, 1):
        found += [f"policy {n}: {k} must be a list of globs" for k in ("scope", "exclude") if k in policy and texts(policy[k])]
        found += [] if policy.get("scope") else [f"policy {n}: needs a scope"]
        for key, value in policy.items():
            if key not in ("scope", "exclude"):
                wrong = one_of(*allowed[key])(value) if key in allowed else "is an unknown setting"
                found += [f"policy {n}: {key} {wrong}"] if wrong else []
    return found


def settings_of(raw: dict, allowed: dict[str, tuple] = POLICY_VALUES) -> Settings:
    """The settings with defaults filled in; raises SettingsError with all problems."""
    problems = [f"unknown section {s!r}" for s in raw if s not in SETTINGS and s != "policy"]
    problems += problems_of_policies(raw.get("policy", []), allowed)
    values: dict[str, dict[str, Any]] = {}
    for section, keys in SETTINGS.items():
        given = raw.get(section, {})
        if not isinstance(given, dict):
            problems.append(f"{section} must be a table")
            given = {}
        problems += [f"unknown key {section}.{k}" for k in given if k not in keys]
        values[section] = {k: given.get(k, s.default) for k, s in keys.items()}
        problems += [f"{section}.{k} {wrong}" for k, s in keys.items() if (wrong := s.check(values[section][k]))]
    if not problems:
        if values["albums"]["soft_cap"] > values["albums"]["hard_cap"]:
            problems.append("albums.soft_cap must not exceed albums.hard_cap")
        if values["import"]["same_max"] >= values["import"]["different_min"]:
            problems.append("import.same_max must be below import.different_min")
        if unknown := [d for d in values["organize"]["dates"] if d not in DATE_SOURCES]:
            problems.append(f"organize.dates has unknown sources {unknown}")
    if problems:
        raise SettingsError(problems)
    return Settings(values, list(raw.get("policy", [])))
