"""Settings: defaults, files, environment, command line; each checked when it is made."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import urlsplit

from ..operators import ranking


class SiftError(Exception):
    """Base of this package's errors."""


class ConfigError(SiftError, ValueError):
    """A setting outside its range, or a file that cannot be read."""


class ProviderError(SiftError):
    """A source failed; ``status`` is its HTTP status, if it has one."""

    def __init__(self, provider: str, message: str, status: int | None = None):
        super().__init__(message)
        self.provider, self.status = provider, status


class OutputError(SiftError):
    """A report could not be written."""


class CacheError(SiftError):
    """The cache folder cannot be used."""


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _whole(x, least: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _share(x) -> bool:
    return isinstance(x, int | float) and 0 <= x <= 1


@dataclass(frozen=True)
class Provider:
    enabled: bool = True
    api_key: str | None = None
    rate: float = 1.0
    feeds: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _check(isinstance(self.rate, int | float) and self.rate > 0, "rate must be positive")
        _check(all(urlsplit(f).scheme and urlsplit(f).netloc for f in self.feeds), "feeds must be URLs")


@dataclass(frozen=True)
class Report:
    format: str = "markdown"
    directory: str = "./output"
    template: str = "notes"
    vault: str | None = None
    folder: str = "Resources/Aggregated"
    tags: tuple[str, ...] = ("quarrysift", "auto-aggregated")
    front_matter: bool = True

    def __post_init__(self) -> None:
        _check(self.format in ("markdown", "json"), "format is markdown or json")


_PROVIDERS = {"brave": Provider(False), "duckduckgo": Provider(rate=0.5), "rss": Provider(), "serp": Provider(False)}


@dataclass(frozen=True)
class Config:
    limit: int = 20
    timeout_ms: int = 10_000
    retries: int = 2
    weights: tuple[float, float, float] = (0.3, 0.2, 0.5)
    trusted: tuple[str, ...] = tuple(ranking.TRUSTED)
    by_url: bool = True
    by_content: bool = True
    similarity: float = 0.85
    cache: bool = True
    cache_folder: str = "./.quarrysift-cache"
    cache_ttl_ms: int = 3_600_000
    providers: dict[str, Provider] = field(default_factory=lambda: dict(_PROVIDERS))
    report: Report = field(default_factory=Report)

    def __post_init__(self) -> None:
        _check(_whole(self.limit, 1) and _whole(self.timeout_ms, 1) and _whole(self.cache_ttl_ms, 1), "limits must be positive whole numbers")
        _check(_whole(self.retries, 0), "retries must not be negative")
        _check(len(self.weights) == 3 and all(map(_share, (*self.weights, self.similarity))), "weights and similarity lie between 0 and 1")
        _check(set(self.providers) <= set(_PROVIDERS), f"providers are {', '.join(_PROVIDERS)}")

    def merged(self, providers: list[str] | None = None, limit: int | None = None, timeout_ms: int | None = None, output: str | None = None, format: str | None = None) -> Config:
        """With what the command line says; sources that need a key stay off without one."""
        new: dict = {k: v for k, v in (("limit", limit), ("timeout_ms", timeout_ms)) if v is not None}
        if providers is not None:
            keyed = ("brave", "serp")
            new["providers"] = {n: dataclasses.replace(p, enabled=n in providers and (n not in keyed or bool(p.api_key))) for n, p in self.providers.items()}
        report = {k: v for k, v in (("directory", output), ("format", format)) if v is not None}
        return dataclasses.replace(self, **new, **({"report": dataclasses.replace(self.report, **report)} if report else {}))


#: Where settings are looked for, the first that exists.
PATHS = ("./config/local.yaml", "./config/default.yaml", "./quarrysift.yaml", "./quarrysift.yml")


def expand_env(value):
    """``${NAME}`` in strings of nested lists and dicts replaced by the environment, else ''."""
    if isinstance(value, str):
        return re.sub(r"\$\{([^}]+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    return [expand_env(v) for v in value] if isinstance(value, list) else value


def _parse(text: str, path: str):
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:  # YAML holds JSON
        return json.loads(text)
    return yaml.safe_load(text)


def from_dict(data: dict) -> Config:
    """Settings from nested sections: providers, search, scoring, deduplication, output, cache."""
    _check(isinstance(data, dict), "settings are a table of sections")
    part = lambda name: data.get(name) or {}
    search, scoring, dedup, out, cache = map(part, ("search", "scoring", "deduplication", "output", "cache"))
    notes = out.get("obsidian") or {}
    weights = scoring.get("weights") or {}
    pick = lambda section, **names: {ours: section[theirs] for ours, theirs in names.items() if theirs in section}
    providers = dict(_PROVIDERS)
    for name, p in part("providers").items():
        got = pick(p or {}, enabled="enabled", api_key="apiKey", rate="rateLimit")
        providers[name] = dataclasses.replace(_PROVIDERS.get(name, Provider()), **got, feeds=tuple((p or {}).get("feeds") or ()))
    report = pick(out, format="format", directory="directory", template="template") | pick(notes, vault="vault", folder="folder", front_matter="frontmatter")
    if "tags" in notes:
        report["tags"] = tuple(notes["tags"])
    try:
        return Config(
            **pick(search, limit="defaultLimit", timeout_ms="timeout", retries="retries"),
            **({"weights": tuple(weights.get(k, d) for k, d in (("recency", 0.3), ("domainAuthority", 0.2), ("keywordRelevance", 0.5)))} if weights else {}),
            **({"trusted": tuple(scoring["trustedDomains"])} if "trustedDomains" in scoring else {}),
            **pick(dedup, by_url="urlNormalization", by_content="contentFingerprint", similarity="similarityThreshold"),
            **pick(cache, cache="enabled", cache_folder="directory", cache_ttl_ms="ttlMs"),
            providers=providers,
            report=Report(**report),
        )
    except TypeError as e:
        raise ConfigError(str(e)) from e


def load(path: str | None = None) -> Config:
    """Settings of the first file that exists, or defaults; an unreadable file raises."""
    for p in (path,) if path else PATHS:
        if os.path.exists(p):
            try:
                with open(p) as f:
                    data = _parse(f.read(), p) or {}
            except Exception as e:
                raise ConfigError(f"cannot read {p}: {e}") from e
            return from_dict(expand_env(data))
    return Config()


def date_range(since: str | None, until: str | None, now: datetime | None = None) -> tuple[datetime, datetime] | None:
    """Both ends of a range; a day alone is its midnight UTC; nothing asked gives None."""
    if not since and not until:
        return None

    def parse(text: str) -> datetime:
        try:
            t = datetime.fromisoformat(text)
        except ValueError as e:
            raise ConfigError(f"invalid date: {text}; use YYYY-MM-DD") from e
        return t if t.tzinfo else t.replace(tzinfo=UTC)

    return parse(since) if since else datetime.fromtimestamp(0, UTC), parse(until) if until else now or datetime.now(UTC)
