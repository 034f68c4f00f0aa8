"""Driver-side control: configuration, cache, rate limits, interactive sessions."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking, refine, results
from ..operators.rounds import Rounds
from .config import Config


def parse_selection(text: str, most: int) -> list[int]:
    """``1,3-5`` as sorted different numbers from 1 to ``most``; bad parts are ignored."""
    out: set[int] = set()
    for part in text.split(","):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            out |= {n for n in range(a, b + 1) if a and b and 1 <= n <= most}
    return sorted(out)


class TokenBucket:
    """Capacity max(1, rate), refilled at ``rate`` tokens a second."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.capacity, self.clock = rate, max(1.0, rate), clock
        self.tokens, self.at = self.capacity, clock()

    def _refill(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now

    def try_acquire(self) -> bool:
        self._refill()
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False

    def acquire(self, sleep: Callable[[float], None] = time.sleep) -> None:
        """Waits until a token is there and takes it."""
        self._refill()
        if self.tokens < 1:
            sleep((1 - self.tokens) / self.rate)
            self._refill()
        self.tokens -= 1


class FileCache:
    """JSON values by key in a driver's folder, dropped ``ttl_ms`` after they are set."""

    def __init__(self, folder: str, ttl_ms: int, clock: Callable[[], float] = time.time):
        self.folder, self.ttl_ms, self.clock = Path(folder), ttl_ms, clock

    def _path(self, key: str) -> Path:
        return self.folder / f"{hashlib.sha256(key.encode()).hexdigest()[:16]}.json"

    def get(self, key: str):
        try:
            entry = json.loads(self._path(key).read_text())
            return None if self.clock() * 1000 - entry["timestamp"] > self.ttl_ms else entry["value"]
        except (OSError, ValueError, KeyError):
            return None

    def set(self, key: str, value) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._path(key).write_text(json.dumps({"timestamp": self.clock() * 1000, "value": value}))

    def clear(self) -> int:
        """Remove all entries; how many."""
        entries = list(self.folder.glob("*.json"))
        for p in entries:
            p.unlink()
        return len(entries)

    def stats(self) -> dict[str, int]:
        entries = list(self.folder.glob("*.json"))
        return {"entries": len(entries), "bytes": sum(p.stat().st_size for p in entries)}

    def prune(self) -> int:
        """Remove expired and unreadable entries; how many."""
        n = 0
        for p in self.folder.glob("*.json"):
            try:
                old = self.clock() * 1000 - json.loads(p.read_text())["timestamp"] > self.ttl_ms
            except (OSError, ValueError, KeyError):
                old = True
            if old:
                p.unlink()
                n += 1
        return n


@dataclass
class Session:
    """Rounds of searching: results accumulate without repeats, in written tables."""

    fetch: Callable[[str], DataFrame]
    as_of: Column
    config: Config = field(default_factory=Config)
    max_depth: int = 3
    query: str = ""
    depth: int = 0
    found: DataFrame | None = None
    rounds: Rounds | None = None

    def search(self, query: str) -> DataFrame:
        """One more round; gives its suggestions."""
        self.query, self.depth = self.query or query, self.depth + 1
        new = self.fetch(query)
        self.rounds = self.rounds or Rounds(new.sparkSession, results.dedup_key(self.config.by_url, self.config.by_content))
        self.rounds.add(new)
        self.found = self.rounds.total().drop("round")
        return refine.suggestions(new, query)

    def final(self, n: int | None = None) -> DataFrame:
        """All results scored against the first query."""
        scored = ranking.scored(self.found, self.query, self.as_of, list(self.config.trusted), self.config.weights)
        return ranking.top(scored, ["score"], n) if n else scored.orderBy(F.desc("score"), "ord")


class Categories:
    """Category rules (name, host parts, keywords, URL parts); a later rule of a name replaces it."""

    def __init__(self, rules=results.CATEGORIES):
        self.rules = list(rules)

    def add(self, name: str, hosts=(), keywords=(), urls=()) -> None:
        self.remove(name)
        self.rules.append((name, list(hosts), list(keywords), list(urls)))

    def remove(self, name: str) -> None:
        self.rules = [r for r in self.rules if r[0] != name]

    def names(self) -> list[str]:
        return [r[0] for r in self.rules]


HELP = "/add TEXT, /query TEXT, /expand, /narrow, /pivot, /results, /export, /history, /help, /done; or numbers, or more words"


class Dialog:
    """Interactive refinement: ``step`` takes a line and says what came of it.

    Numbers choose suggestions, and the next line a strategy (n.. narrow, p.. pivot, else
    expand), whose first three queries run. Other text is added to the query.
    """

    def __init__(self, session: Session, query: str):
        self.session, self.query, self.history, self.chosen = session, query, [query], []
        self.terms = self._search(query)

    def _search(self, query: str) -> list[str]:
        self.terms = [r.term for r in self.session.search(query).collect()]
        return self.terms

    def _run(self, queries: list[str]) -> dict:
        for q in queries:
            self.history.append(q)
            self._search(q)
        return {"ran": queries, "suggestions": self.terms, "confirm": self.session.depth >= self.session.max_depth}

    def _refined(self, strategy: str, terms: list[str]) -> list[str]:
        spark = self.session.found.sparkSession
        row = spark.range(1).select(refine.refined_queries(self.query, F.array(*map(F.lit, terms)), strategy).alias("q")).first() if terms else None
        return list(row.q) if row else []

    def step(self, line: str) -> dict:
        line = line.strip()
        command, _, rest = line.partition(" ")
        if self.chosen:
            kind = "narrow" if line.lower().startswith("n") else "pivot" if line.lower().startswith("p") else "expand"
            terms, self.chosen = self.chosen, []
            return self._run(self._refined(kind, terms)[:3])
        if command in ("/done", "/finish", "/quit", "/exit"):
            return {"done": True, "keep": command in ("/done", "/finish")}
        if command == "/query" and rest:
            self.query, self.session.query, self.session.depth = rest, rest, 0
            return self._run([rest])
        if command == "/add" and rest:
            self.query = f"{self.query} {rest}"
            return self._run([self.query])
        if command in ("/expand", "/narrow", "/pivot"):
            most = {"/expand": 3, "/narrow": 2, "/pivot": 1}[command]
            return self._run(self._refined(command[1:], self.terms[:3])[:most])
        if command in ("/results", "/export"):
            return {command[1:]: self.session.final()}
        if command == "/history":
            return {"history": list(self.history)}
        if command.startswith("/") or not line:
            return {"help": HELP}
        if re.fullmatch(r"[\d\s,-]+", line):
            self.chosen = [self.terms[n - 1] for n in parse_selection(line, len(self.terms))]
            return {"chosen": self.chosen}
        self.query = f"{self.query} {line}"
        return self._run([self.query])
