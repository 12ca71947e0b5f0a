"""URL rules by a cascade of Bloom filters.

Each url yields candidate keys: every suffix of its host's labels joined with
each prefix of its path whose length some rule has.  Level 1 of the cascade holds
the listed rules; level 2 those candidate keys of the whole corpus that level 1
wrongly accepts; level 3 the listed rules that level 2 accepts; and so on until
no false positive is left.  Over that complete key universe, the parity of the
first refusing level gives exact membership, so urls meet the rules without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import mix, xxh64


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: Verdict of a url whose candidate keys the cascade refuses: it isn't listed.
UNLISTED = "allow"


def key_hashes(keys: Sequence[str]) -> np.ndarray:
    blobs = [k.encode("utf-8", "surrogatepass") for k in keys]
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    return xxh64(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(size) - size, size)


class Bloom:
    """A Bloom filter over 64-bit key hashes; `level` gives each filter its own probes."""

    def __init__(self, hashes: np.ndarray, rate: float, level: int) -> None:
        self.level = level
        self.probes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(max(1, len(hashes)) * self.probes / math.log(2)))
        self.bits = np.zeros(self.size, bool)
        for at in self.places(hashes):
            self.bits[at] = True

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mix(hashes + np.uint64(2 * self.level + 1) * np.uint64(0x9E3779B97F4A7C15))
            b = mix(a ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
            for k in range(self.probes):
                yield ((a + np.uint64(k) * b) % np.uint64(self.size)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            found &= self.bits[at]
        return found


class Cascade:
    """Alternating Bloom filters: odd levels hold listed keys, even ones false positives.

    Unlisted keys with the hash of a listed one can't be told apart by any level; they are kept by name in `clashing`.
    """

    def __init__(self, levels: list[Bloom], clashing: frozenset[str] = frozenset()) -> None:
        self.levels = levels
        self.clashing = clashing

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Exact for all keys of the universe the cascade was built over."""
        answer = np.zeros(len(hashes), bool)
        live = np.arange(len(hashes))
        for depth, level in enumerate(self.levels):
            kept = level.has(hashes[live])
            answer[live[~kept]] = depth % 2 == 1
            live = live[kept]
        answer[live] = len(self.levels) % 2 == 1
        return answer


def alternate(first: Bloom, yes: np.ndarray, no: np.ndarray) -> list[Bloom]:
    """The levels over listed hashes and what the first level wrongly accepts; no hash may be in both."""
    levels = [first]
    while len(no):
        levels.append(Bloom(no, 0.5, len(levels)))
        yes = yes[levels[-1].has(yes)]
        if not len(yes):
            break
        levels.append(Bloom(yes, 0.5, len(levels)))
        no = no[levels[-1].has(no)]
    return levels


def cascade_over(first: Bloom, listed: Sequence[str], accepted: Sequence[str]) -> Cascade:
    """The cascade whose first level holds `listed` and wrongly accepts the keys `accepted`."""
    yes, no = key_hashes(listed), key_hashes(accepted)
    same = np.isin(no, yes)
    return Cascade(alternate(first, yes, no[~same]), frozenset(k for k, x in zip(accepted, same, strict=True) if x))


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: then up to `?`, `#` or end."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[:min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def candidate_keys(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Keys under which a rule may list this url, longest first (by path, then by host)."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return [h + path[:n] for n in sorted({n for n in lengths if n <= len(path)}, reverse=True) for h in hosts]


def parsed(pages: DataFrame, url_col: str) -> tuple[F.Column, F.Column]:
    """Host and path as expressions; see host_and_path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substr(coalesce({url_col}, ''), instr(coalesce({url_col}, ''), '://') + 3)")).otherwise("")
    plain = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(plain, r"(?s)^([^/]*)", 1)
    path = F.regexp_extract(plain, r"(?s)^[^/]*(.*)$", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def build_cascade(parts: DataFrame, rules: Sequence[Rule]) -> Cascade:
    """Build the levels over all candidate keys of the corpus.

    parts has columns host and path.  Level 1 has a false-positive rate of about
    |rules| / (sqrt(2) |universe|), so what it wrongly accepts numbers about |rules|
    keys and is brought to the driver; each further level sees only those keys.
    """
    listed = sorted({r.host + r.path for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    if not listed:
        return Cascade([])
    hosts = parts.agg(F.approx_count_distinct(F.struct("host", F.expr(f"left(path, {max(lengths)})"))).alias("n")).first()
    universe = max(1, hosts["n"]) * 4 * len(lengths)
    rate = min(0.5, len(listed) / (math.sqrt(2) * universe))
    first = Bloom(key_hashes(listed), rate, 0)
    known = set(listed)

    def wrong(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = sorted({k for h, p in set(zip(*batch.to_pydict().values(), strict=True)) for k in candidate_keys(h, p, lengths)} - known)
            if keys:
                hit = first.has(key_hashes(keys))
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, x in zip(keys, hit, strict=True) if x], pa.string())})

    longest = F.expr(f"left(path, {max(lengths)})")
    accepted = [r["key"] for r in parts.select("host", longest.alias("path")).mapInArrow(wrong, "key string").distinct().collect()]
    return cascade_over(first, listed, accepted)


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", unlisted: str = UNLISTED) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path; of fitting rules the one with the longest host and path wins.
    Urls without `://`, and null urls, have empty host and path and fit no rule.
    A url that fits none gets the cascade's answer for unlisted keys, `unlisted`.
    Of equally long fitting rules the one with the longer path wins; of rules with the same
    host and path the last one given.  Null ids and repeated rows are judged like any other row.
    """
    host, path = parsed(pages, url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    cascade = build_cascade(rows.select("host", "path"), rules)
    lengths = sorted({len(r.path) for r in rules})
    verdicts = {r.host + r.path: r.verdict for r in rules}
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            keys = [candidate_keys(h, p, lengths) for h, p in pairs]
            flat = [k for ks in keys for k in ks]
            listed = cascade.has(key_hashes(flat)) if flat and cascade.levels else np.zeros(len(flat), bool)
            names, at = [], 0
            for ks in keys:
                fits = [k for k, x in zip(ks, listed[at:at + len(ks)], strict=True) if x and k not in cascade.clashing]
                names.append(max(fits, key=len) if fits else None)
                at += len(ks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()),
                 pa.array([unlisted if n is None else verdicts[n] for n in names], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
