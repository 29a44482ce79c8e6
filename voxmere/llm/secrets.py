"""Secret scans: fixed patterns, and guess-cost dynamic programming over values in a credential context.

A value that stands where a credential would, but that the patterns miss, is a secret if it is hard to guess: the least
product of guesses over all its segmentations into words, dates, repeats, keyboard walks and brute-force spans is over a
threshold. Words are ranked by how often they occur in the documents themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.llm.text import shared_checkpoint

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# A value follows a credential's name and : or =, an option of a command line, or a user's name in a URL.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|passphrase|pwd|secret|token|(?:api|access|private|secret|signing)[_-]?key|credentials?|authorization)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:(?:bearer|basic)\x20+)?["'`]?"""
    r"""|--(?:password|passphrase|token|secret|api-key)[\x20=]["']?"""
    r"""|://[^\s/:@"'<>]{1,255}:(?=[^\s/@"'<>]{6,4096}@))"""
    r"""([^\s"'`<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
YEARS = range(1900, 2051)
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.ASCII),
    re.compile(r"(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d", re.ASCII),
    re.compile(r"(?:19|20)\d\d", re.ASCII),
)
DATE_CHARS = range(4, 11)
# Common credential words, in order of rank.
COMMON = ("password", "qwerty", "admin", "welcome", "letmein", "dragon", "monkey", "login", "princess", "football", "master", "hello", "freedom", "whatever", "shadow", "sunshine", "secret", "test", "guest", "root", "user", "changeme", "default", "example", "token", "key", "none", "null", "true", "false", "value", "string", "your", "pass", "abc", "love", "god", "summer", "winter", "spring", "autumn", "baseball", "batman", "superman", "iloveyou", "trustno", "access", "flower", "hunter", "killer", "jordan", "michael", "jennifer", "thomas", "robert", "daniel", "andrew", "joshua", "george", "charlie", "computer", "internet", "server", "service", "system", "temp", "demo", "sample", "placeholder", "here", "insert", "replace")



def _beside() -> dict[str, set[str]]:
    """Keys next to each other in a row of the keyboard."""
    near: dict[str, set[str]] = {}
    for row in ROWS:
        for a, b in zip(row, row[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


BESIDE = _beside()
JOINT, CAPITALS, TURN, START_KEY = math.log10(2), math.log10(2), math.log10(4), math.log10(36)
LEAST_WALK = 3


def lowered(value: str) -> str:
    """value in lower case, character by character, so that places stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(94)


def word_cost(piece: str, low: str, ranks: dict[str, int]) -> float:
    """The rank of low as a word, and two more if piece has capitals; infinite if it is no word."""
    rank = ranks.get(low)
    return math.inf if rank is None else math.log10(1 + rank) + (0.0 if piece == low else CAPITALS)


def date_cost(piece: str) -> float:
    if not any(d.fullmatch(piece) for d in DATES):
        return math.inf
    return math.log10(len(YEARS) * (366 if len(piece) > 4 else 1))


def step_way(a: str, b: str) -> int:
    """1 or -1, by their codes, if key b lies beside key a or follows it in order; else 0."""
    way = ord(b) - ord(a)
    return (1 if way > 0 else -1) if way and (b in BESIDE.get(a, ()) or abs(way) == 1 and a.isalnum() and b.isalnum()) else 0


def repeats_in(low: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of every longest stretch with low[i] == low[i + period], of two periods at least.

    A stretch of period p holds one of the places 0, p, 2p... with its partner; how far the equality reaches from there is
    found by bisection on hashes of prefixes. Of the periods of one stretch the smallest stays.
    """
    n, mod, base = len(low), (1 << 61) - 1, 911382323
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    powers, sums = [1], [0]
    for c in low:
        sums.append((sums[-1] * base + ord(c) + 1) % mod)
        powers.append(powers[-1] * base % mod)

    def same(i: int, j: int, size: int) -> bool:
        return (sums[i + size] - sums[j + size] - (sums[i] - sums[j]) * powers[size]) % mod == 0

    def reach(most: int, fits) -> int:
        size, step = 0, 1
        while step:
            if size + step <= most and fits(size + step):
                size, step = size + step, step * 2
            else:
                step //= 2
        return size

    found: dict[tuple[int, int], int] = {}
    for p in range(1, n // 2 + 1):
        at = np.arange(0, n - p, p)
        for k in at[codes[at] == codes[at + p]].tolist():
            ahead = reach(n - k - p, lambda size, k=k, p=p: same(k, k + p, size))
            back = reach(k, lambda size, k=k, p=p: same(k - size, k + p - size, size))
            if ahead + back >= p:
                found.setdefault((k - back, k + p + ahead), p)
    return sorted((start, end, p) for (start, end), p in found.items())


class Least:
    """The least value that stands from `near` to `far` steps back in a chain that grows value by value."""

    __slots__ = ("near", "far", "seen", "best")

    def __init__(self, near: int, far: int):
        self.near, self.far, self.seen, self.best = near, far, [], deque()

    def behind(self) -> float:
        """The least for the next place of the chain; asked once before each add."""
        now = len(self.seen)
        if now >= self.near:
            new = now - self.near
            while self.best and self.seen[self.best[-1]] >= self.seen[new]:
                self.best.pop()
            self.best.append(new)
        while self.best and self.best[0] < now - self.far:
            self.best.popleft()
        return self.seen[self.best[0]] if self.best else math.inf


def by_digits(least: int, most: int) -> list[tuple[int, Least]]:
    """(number of digits, window) for the counts from least to most."""
    return [(d, Least(max(least, 10 ** (d - 1)), 10**d - 1)) for d in range(len(str(least)), len(str(most)) + 1)]


def guess_cost(value: str, ranks: dict[str, int], lengths: list[int] | None = None) -> float:
    """log10 of the fewest guesses over all segmentations of value, whatever its length; lengths: those that words have.

    A span costs, in log10 guesses: a word, its rank, and two more for capitals; a date, a day in all the years, or a
    year; a repeat of a unit that is no repeat itself, whatever its case, the unit as a word or by brute force and a digit
    for each digit of how often; a keyboard walk of three or more keys, its start, a digit for each digit of its length
    and four for each turn; any other span ten guesses a character as digits, 26 as letters, 94 else. Each further span
    adds log10 2. Brute force adds up by character, and repeats and walks take the least of a sliding window over their
    starts, so the time follows the length and the number of repeats, not the pairs of places.
    """
    n, low = len(value), lowered(value)
    lengths = sorted({len(w) for w in ranks}) if lengths is None else lengths
    best, force, brute = [math.inf] * (n + 1), [0.0], math.inf
    for c in value:
        force.append(force[-1] + char_cost(c))
    way = [0, *(step_way(a, b) for a, b in zip(low, low[1:], strict=False)), 0]
    turns = [0]
    for j in range(1, n + 1):
        turns.append(turns[-1] + (way[j] * way[j - 1] < 0))
    chains: dict[int, list] = {}
    for start, end, period in repeats_in(low):
        for first in range(start, min(start + period, end - 2 * period + 1)):
            unit = slice(first, first + period)
            cost = min(force[first + period] - force[first], word_cost(low[unit], low[unit], ranks))
            windows = by_digits(2, (end - first) // period)
            for j in range(first, end + 1, period):
                chains.setdefault(j, []).append((cost, windows))
    walk: list[tuple[int, Least]] = []
    for j in range(n + 1):
        here = 0.0 if j == 0 else best[j]
        if j:
            brute = min(brute, best[j - 1] + (JOINT if j > 1 else 0.0)) + force[j] - force[j - 1]
            here = min(here, brute)
            for digits, window in walk:
                here = min(here, START_KEY + digits + TURN * turns[j - 1] + window.behind())
        for cost, windows in chains.get(j, ()):
            for digits, window in windows:
                here = min(here, cost + digits + window.behind())
        best[j] = here
        start = here + (JOINT if j else 0.0)
        for _, windows in chains.pop(j, ()):
            for _, window in windows:
                window.seen.append(start)
        if j == n:
            break
        if not (j and way[j]):
            size = next(k for k in range(1, n - j + 1) if not way[j + k])
            walk = by_digits(LEAST_WALK, size) if size >= LEAST_WALK else []
        for _, window in walk:
            window.seen.append(start - TURN * turns[min(j + 1, n)])
        for size in lengths:
            if j + size > n:
                break
            if (cost := word_cost(value[j : j + size], low[j : j + size], ranks)) < math.inf:
                best[j + size] = min(best[j + size], start + cost)
        if value[j].isdigit():
            for size in DATE_CHARS:
                if j + size <= n:
                    best[j + size] = min(best[j + size], start + date_cost(value[j : j + size]))
    return best[n]


def find_spans(text: str, ranks: dict[str, int], least_cost: float, lengths: list[int] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """(base spans, added spans, costed values); a span is (start, order of its kind, end).

    Added is the whole value of a credential that costs enough, unless one base span covers it; base spans stay as they are.
    """
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts, ends = [s for s, _, _ in base], []
    for _, _, e in base:
        ends.append(max(e, ends[-1]) if ends else e)
    added, costs = [], []
    for m in CONTEXT.finditer(text):
        value = m[1].split("@")[0] if text.startswith("://", m.start()) else m[1]
        value = value.rstrip(".:!?)]}")
        if len(value) < 6:
            continue
        start, end = m.start(1), m.start(1) + len(value)
        cost = guess_cost(value, ranks, lengths)
        costs.append((start, end, cost))
        before = bisect_right(starts, start)
        if cost >= least_cost and not (before and ends[before - 1] >= end):  # a base span that ends early leaves the rest open
            added.append((start, 3, end))
    return base, added, costs


KINDS = ("assign", "access", "hex", "guess")
_OUT = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_guess", "long"), ("weak_values", "long"), ("max_cost", "double")]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def word_ranks(docs: DataFrame, text_col: str = "text", share: int = 50_000) -> dict[str, int]:
    """The words that make up at least 1/share of all words of all texts, by rank, after the common credential words.

    Words are runs of three letters or more in lower case. There can be no more than `share` of them, whatever the input.
    """
    found = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}]+"))
    counts = shared_checkpoint(docs.select(found.alias("word")).filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranks = {w: k + 1 for k, w in enumerate(COMMON)}
    for k, row in enumerate(sorted(counts.filter(F.col("n") * share >= total).collect(), key=lambda r: (-r["n"], r["word"]))):
        ranks.setdefault(row["word"], k + 1)
    return ranks


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 10.0, share: int = 50_000) -> DataFrame:
    """One row for each row of docs, over whole texts.

    (id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, weak_values, max_cost): pattern spans, and spans that
    the guess costs add (kind guess); weak_values counts credential values that are easy to guess, max_cost is the log10
    guesses of the hardest. Offsets are code points, ends exclusive. A null text counts as empty, whole texts of any
    length are read, repeated rows and null ids are kept as they are, other columns are not read, and an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col, share))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        lengths = sorted({len(w) for w in ranks})
        for batch in batches:
            out: dict[str, list] = {name: [] for name, _ in _OUT}
            for text in batch.column(1).to_pylist():
                base, added, costs = find_spans(text, ranks, least_cost, lengths)
                for kind in range(3):
                    out[_OUT[kind][0]].append(sum(k == kind for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                out["spans"].append(_listed(base + added))
                out["n_guess"].append(len(added))
                out["weak_values"].append(sum(c < least_cost for _, _, c in costs))
                out["max_cost"].append(max((c for _, _, c in costs), default=None))
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[name], kinds[kind]) for name, kind in _OUT)], ["id", *(name for name, _ in _OUT)])

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(scan, f"id {kind}, " + ", ".join(f"{n} {k}" for n, k in _OUT)).withColumnRenamed("id", id_col)
