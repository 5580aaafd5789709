"""Configuration of a run: what each setting is, what it may be, and what it is where it is left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

#: Kinds of sites and models (fixed values).
KINDS = ("gov_general", "org_general", "cacp_api", "chsla_api")
PROVIDERS = ("ollama", "agnes")


class ConfigError(ValueError):
    """A configuration that can't be run; `faults` has all that is wrong with it."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Setting:
    """A setting: where it stands (`*` is every enabled entry of a list), what it is where it is missing, and what holds for it."""

    path: str
    default: object
    holds: Callable[[object], bool]
    means: str


_real = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
_whole = lambda low, high=float("inf"): lambda v: isinstance(v, int) and not isinstance(v, bool) and low <= v <= high
_text = lambda v: isinstance(v, str) and bool(v.strip())
_listed = lambda each, least=0: lambda v: isinstance(v, list) and len(v) >= least and all(map(each, v))
_mapped = _listed(lambda v: isinstance(v, dict))

SETTINGS = (
    Setting("storage.dedup_days", 90, _whole(1), "a number of days of 1 or more"),
    Setting("health.failure_alert_threshold", 3, _whole(1), "a number of 1 or more"),
    Setting("health.all_failed_retry_delays_minutes", [30, 90], _listed(lambda v: _real(v) and v >= 0), "a list of minutes of 0 or more"),
    Setting("notification.aggregator_delay_hours", 24, lambda v: _real(v) and v >= 0, "a number of hours of 0 or more"),
    Setting("crawler.detail.enabled", True, lambda v: isinstance(v, bool), "yes or no"),
    Setting("crawler.detail.min_existing_length", 120, _whole(0), "a length of 0 or more"),
    Setting("filter.keywords", None, _listed(_text, 1), "a list with entries"),
    Setting("filter.exclude_keywords", [], _listed(_text), "a list of texts"),
    Setting("filter.ai.enabled", True, lambda v: isinstance(v, bool), "yes or no"),
    Setting("filter.ai.max_workers", 1, _whole(1, 4), "1 to 4"),
    Setting("sources.websites", [], _mapped, "a list of mappings"),
    Setting("sources.wechat_accounts", [], _mapped, "a list of mappings"),
    Setting("sources.websites.*.name", None, _text, "a name"),
    Setting("sources.websites.*.url", None, _text, "an address"),
    Setting("sources.websites.*.type", "org_general", lambda v: v in KINDS, f"one of {', '.join(KINDS)}"),
    Setting("sources.wechat_accounts.*.name", None, _text, "a name"),
    Setting("sources.wechat_accounts.*.keyword", None, _text, "a search word"),
)
#: What a model needs, the first one and the one behind it.
MODEL = (
    Setting("provider", PROVIDERS[0], lambda v: isinstance(v, str) and v.lower() in PROVIDERS, f"one of {', '.join(PROVIDERS)}"),
    Setting("api_url", None, _text, "an address"),
    Setting("model", None, _text, "a name"),
)
_BY_PATH = {s.path: s for s in SETTINGS}


def _values(config: object, path: str, default: object) -> Iterator[object]:
    """The values at a path, or the default where it ends early."""
    if not path:
        yield config
        return
    head, _, rest = path.partition(".")
    if head == "*":
        for entry in config if isinstance(config, list) else []:
            if isinstance(entry, dict) and entry.get("enabled", True):
                yield from _values(entry, rest, default)
    elif isinstance(config, dict) and config.get(head) is not None:
        yield from _values(config[head], rest, default)
    elif "*" not in rest.split("."):
        yield default


def get(config: dict, path: str):
    """A setting by its path, with its default."""
    return next(_values(config, path, _BY_PATH[path].default))


def enabled(config: dict, group: str) -> list[dict]:
    """The entries of a group of sources that take part."""
    found = (config.get("sources") or {}).get(group) or []
    return [s for s in found if isinstance(s, dict) and s.get("enabled", True)]


def faults(config: object, dry_run: bool = False) -> list[str]:
    """Everything that is wrong with a configuration."""
    if not isinstance(config, dict):
        return ["the configuration is no mapping"]
    found = [f"{s.path}: must be {s.means}" for s in SETTINGS if not all(s.holds(v) for v in _values(config, s.path, s.default))]
    sites, accounts = enabled(config, "websites"), enabled(config, "wechat_accounts")
    names = [s.get("name") for s in sites]
    model = (config.get("filter") or {}).get("ai") or {}
    models = [("filter.ai", model)] if model.get("enabled", True) else []
    if models and (model.get("fallback") or {}).get("provider"):
        models.append(("filter.ai.fallback", model["fallback"]))
    found += [f"{at}.{s.path}: must be {s.means}" for at, m in models for s in MODEL if not all(s.holds(v) for v in _values(m, s.path, s.default))]
    if not sites and not accounts:
        found.append("sources: none is enabled")
    if len(set(map(str, names))) < len(names):
        found.append("sources.websites: a name repeats")
    if not dry_run and not next(_values(config, "notification.feishu.webhook_url", None)):
        found.append("notification.feishu.webhook_url: needed unless nothing is sent")
    return found


def check(config: dict, dry_run: bool = False) -> dict:
    """The configuration, if nothing is wrong with it."""
    if found := faults(config, dry_run):
        raise ConfigError(found)
    return config


def load(path: str) -> dict:
    """A YAML mapping; relative paths under `storage` are resolved beside the file."""
    import yaml

    file = Path(path).resolve()
    config = yaml.safe_load(file.read_text(encoding="utf-8"))
    if not isinstance(config, dict):
        raise ConfigError(["the configuration is no mapping"])
    storage = config.get("storage") or {}
    # an absolute path beside a folder is itself
    return config | {"storage": storage | {k: str(file.parent / v) for k, v in storage.items() if k.endswith("_path")}}


def source_rows(config: dict) -> list[tuple[str, str, str, int]]:
    """(name, kind, tier, pos) of all configured sources, for the tier lookup."""
    groups = (("websites", "website", "official_website"), ("wechat_accounts", "wechat", "official_wechat"))
    rows = [(s.get("name"), kind, s.get("source_tier", tier)) for group, kind, tier in groups for s in (config.get("sources") or {}).get(group) or []]
    return [(*row, i) for i, row in enumerate(rows)]
