"""Secret scan: fixed patterns, plus credential-context values that are hard to guess.

The value's guess cost is the least sum over all segmentations into common words, dates, repeats, keyboard walks and
brute-force characters (a dynamic programme over the value's positions, log10 of guesses). Values whose cheapest
segmentation still takes 10**8 guesses or more are secrets; weak or placeholder values are not.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table, utf8

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 8.0

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:auth|access|refresh)?[_-]?token|(?:api|access|private)[_-]?key"""
    r"""|credentials?|client[_-]?secret|authorization)["']?[ \t]*(?::=|=>|[:=]|\bis\b)[ \t]*(?:(?:bearer|basic)[ \t]+)?"""
    r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>`]{6,}))""", re.ASCII | re.IGNORECASE)
_USERINFO = re.compile(r"://[^\s/:@]++:([^\s/@]{6,})@", re.ASCII)
#: One of these is in every text that _ASSIGN, _CONTEXT or _USERINFO can match (lower case).
_NEEDLES = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"authorization", b"://")

#: Common words of passwords, most common first (fixed values of this operator).
WORDS = """password pass admin user login welcome letmein secret monkey dragon master sunshine princess football baseball
superman batman shadow michael jordan hunter ranger soccer hockey killer george charlie andrew thomas robert daniel jessica
ashley nicole hannah amanda love iloveyou freedom whatever trustno test testing guest root server mysql oracle default
changeme change example sample token access key api private public summer winter spring autumn monday friday january
march april june july august october december hello world computer internet google apple orange banana cookie pepper
ginger silver golden purple yellow green blue black white tiger lion eagle falcon wolf bear horse money star moon
angel happy lucky magic power rocket matrix ninja flower cheese coffee chocolate london paris berlin madrid america
german france house home family friend mother father sister brother baby junior the and not you this that your""".split()
_LEET = str.maketrans("4@310!5$7", "aaeloisst")
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Dates by year, by day, and years alone: each is offered for itself.
_DATES = [re.compile(p, re.ASCII) for p in (r"\d{4}([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", r"(?:19|20)\d\d")]
_KEYS = {c: (r, i) for r, row in enumerate(("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")) for i, c in enumerate(row)}
_SEGMENT = math.log10(2)


def _alphabet(c: str) -> float:
    return math.log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)


class _Starts:
    """Starts of spans of one kind that may be the best for some end, in one run.

    A span from i to j costs cost(i) + steady(j) - steady(i) + log10((j - i) / unit) + a constant. Of two starts the later one
    gains most at the nearest end; where it does not win there, it never does and is left out. In a long run that leaves few.
    """

    def __init__(self, unit: int, least: int):
        self.unit, self.least, self.kept = unit, least, []

    def add(self, i: int, base: float) -> None:
        near = i + self.least
        if all((i - k) % self.unit or b + math.log10(near - k) > base + math.log10(near - i) for k, b in self.kept):
            self.kept.append((i, base))

    def best(self, j: int) -> float:
        return min((b + math.log10((j - i) / self.unit) for i, b in self.kept if j - i >= self.least and (j - i) % self.unit == 0), default=math.inf)


def _period_runs(value: str) -> list[tuple[int, int, int]]:
    """(unit, first, last) of every stretch in which each character equals the one ``unit`` places on, for at least two copies.
    Units are primitive: a stretch inside one of a unit that divides its own is left out."""
    n, out = len(value), []
    code = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    for u in range(1, n // 2 + 1):
        same = code[:-u] == code[u:]
        if not same.any():
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= u and not any(u % v == 0 and x <= a and b + u <= z for v, x, z in out):
                out.append((u, a, b + u))
    return out


def guess_cost(value: str, words: tuple[str, ...] = tuple(WORDS), ranked=None) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes, into words (the most common first), dates, copies
    of a primitive unit of any length (priced at its own least cost), walks of any length and brute-force characters."""
    return _guess_cost(value, ranked or _ranked(words))


def _ranked(words: tuple[str, ...]):
    ranks: dict[str, int] = {}
    for w in words:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks, sorted({len(w) for w in ranks})


def _guess_cost(value: str, ranked, units: dict[str, float] | None = None) -> float:
    ranks, lengths = ranked
    units = {} if units is None else units
    n, lower = len(value), value.translate(_ASCII_LOWER)
    plain = lower.translate(_LEET)
    cost = [0.0] + [math.inf] * n
    step = []
    for a, b in zip(lower, lower[1:]):
        p, q = _KEYS.get(a), _KEYS.get(b)
        near = (q[0] - p[0], q[1] - p[1]) if p and q and max(abs(q[0] - p[0]), abs(q[1] - p[1])) == 1 else None
        order = ord(b) - ord(a)
        step.append(near or ((9, order) if abs(order) == 1 and a.isalnum() and b.isalnum() else None))
    # turns[j]: turns among the steps before the character at j, counted over the whole value
    turns = [0] * (n + 1)
    for j in range(2, n):
        turns[j] = turns[j - 1] + (step[j - 1] is not None and step[j - 2] is not None and step[j - 1] != step[j - 2])
    runs: dict[int, list[tuple[int, int]]] = {}
    for u, a, z in _period_runs(value):
        runs.setdefault(a, []).append((u, z))
    repeats: list[tuple[_Starts, int]] = []  # the stretches that hold the current place, with their ends
    walk = _Starts(1, 4)

    for i in range(n + 1):
        # spans that end here
        for starts, z in repeats:
            if i <= z:
                cost[i] = min(cost[i], starts.best(i) + _SEGMENT)
        if i >= 4:
            cost[i] = min(cost[i], walk.best(i) + math.log10(36) + turns[i - 1] * math.log10(8) + _SEGMENT)
        if i == n:
            break
        # spans that begin here
        cost[i + 1] = min(cost[i + 1], cost[i] + _alphabet(value[i]))
        for size in lengths:
            if i + size > n:
                break
            asis = lower[i : i + size]
            rank = ranks.get(asis) or ranks.get(plain[i : i + size])
            if rank:
                variants = 1 + (value[i : i + size] != asis) + sum(a != b for a, b in zip(asis, plain[i : i + size]) if asis not in ranks)
                cost[i + size] = min(cost[i + size], cost[i] + math.log10(rank + 1) + math.log10(variants) + _SEGMENT)
        for pattern in _DATES:
            if m := pattern.match(value, i):
                cost[m.end()] = min(cost[m.end()], cost[i] + math.log10(200) + (math.log10(365) if m.end() - i > 4 else 0) + _SEGMENT)
        repeats = [(s, z) for s, z in repeats if i < z] + [(_Starts(u, 2 * u), z) for u, z in runs.get(i, ())]
        for starts, z in repeats:
            if z - i < 2 * starts.unit:
                continue
            unit = value[i : i + starts.unit]
            if unit not in units:
                units[unit] = _guess_cost(unit, ranked, units)
            starts.add(i, cost[i] + units[unit])
        if i == 0 or step[i - 1] is None:
            walk = _Starts(1, 4)
        if i < len(step) and step[i] is not None:
            # a turn at the start itself does not belong to the walk
            walk.add(i, cost[i] - turns[i + 1] * math.log10(8))
    return cost[n]


def find(text: str, base: bool = True, least: float = LEAST_COST, words: tuple[str, ...] = tuple(WORDS), ranked=None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then kind. ranked: ``_ranked(words)``, if it is at hand."""
    out, ranked = [], ranked or _ranked(words)
    if base:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found = set()
    for pattern in (_CONTEXT, _USERINFO):
        for m in pattern.finditer(text):
            g = next(i for i in range(1, len(m.groups()) + 1) if m[i] is not None)
            value = m[g].rstrip(".,;:)]}") if pattern is _CONTEXT and g == 3 else m[g]
            if len(value) >= 6 and guess_cost(value, words, ranked) >= least:
                found.add(("guess", m.start(g), m.start(g) + len(value)))
    return sorted(out + list(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[[*range(48, 58), *range(97, 103)]] = True


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a run of 24 hex digits: such a run covers a whole aligned block of 12 bytes."""
    blocks = _HEXDIGIT[data[: len(data) // 12 * 12]].reshape(-1, 12).all(axis=1)
    out = np.zeros(len(offsets) - 1, bool)
    hit = np.flatnonzero(blocks) * 12
    out[np.searchsorted(offsets, hit, side="right") - 1] = True
    return out


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = LEAST_COST, words: tuple[str, ...] = tuple(WORDS)) -> DataFrame:
    """Secrets of every whole text: one row for each input row.

    base: ``assign`` spans cover the whole match (its value has 6 characters or more), ``access`` 20 or more, ``hex`` 24 or
    more; ``guess`` spans cover the value alone. ``words`` are the common words of passwords, the most common first. A null text
    counts as empty; ids may be null or repeated; whole texts are read, however long; an empty table gives no rows; other columns
    are ignored. Text is only decoded and matched where a cheap look at its bytes leaves a match possible.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        ranked = _ranked(words)
        for b in batches:
            data, offsets = utf8(b.column(1))
            n = [np.zeros(b.num_rows, np.int64) for _ in KINDS]
            digest, spans = [nothing] * b.num_rows, [""] * b.num_rows
            for i, j in pieces(offsets):
                off = offsets[i : j + 1]
                raw = data[off[0] : off[-1]]
                hexes, raw = _suspects(raw, off - off[0]), raw.tobytes()
                low = raw.lower()
                for r in range(i, j):
                    a, z = off[r - i] - off[0], off[r - i + 1] - off[0]
                    if hexes[r - i] or raw.find(b"AKIA", a, z) >= 0 or any(low.find(w, a, z) >= 0 for w in _NEEDLES):
                        if got := find(raw[a:z].decode("utf-8", "replace"), least=least, ranked=ranked):
                            spans[r] = _joined(got)
                            digest[r] = hashlib.sha256(_joined(s for s in got if s[0] != "guess").encode()).hexdigest()
                            for kind, _, _ in got:
                                n[KINDS.index(kind)][r] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(n[3])],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    from pyspark.sql import functions as F
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, OUT)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
