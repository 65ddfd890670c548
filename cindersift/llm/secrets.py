"""Secrets in texts: fixed patterns, and further tokens whose format probabilistic automata learnt from labelled credentials.

Base spans follow three patterns, leftmost and not overlapping within a kind. Every other run of CANDIDATE characters with
LEAST of them or more, a letter and a digit, is a candidate, and added as a ``credential`` if its format is likelier under the automaton
of credentials than under that of ordinary tokens, by a margin calibrated on a held-out fifth.

An automaton is inferred from the table's tokens by state merging (ALERGIA): Spark counts all prefixes of the tokens, the
counts form a prefix tree, and from the root outwards a state is merged with the first one whose frequencies of ending and
going on are compatible with its own under the Hoeffding bound, and whose successors are; else it stays as a state of its
own. A token's symbols are its literal characters as long as its prefix is a frequent one of the table (``ghp_``,
``AIza``), then the kinds of its characters, so formats are learnt and random parts generalise.

Texts are read in Arrow batches. Long runs are found by doubling: a run of 2n characters is two runs of n, one ``and``
of two bit arrays. The table has LABELLED_ROWS rows, so prefixes and automata are bounded (some thousand states) and go to
tasks with the function.

Defined results: null and empty texts have no spans; every row is judged alone, so repeated rows and null ids keep theirs; a
candidate that meets a base span is not added, so added spans never overlap any; positions are code points, ends exclusive; texts and
tokens of any length are read whole; an empty table gives no rows; other columns pass through :func:`scanned`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cindersift.llm import secret_forms
from cindersift.llm.hashing import returning

#: Fixed values, in this order; after them the kind of added spans.
KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, "credential")
#: The patterns as given, over texts whose A-Z are lower-cased ("assign") or as they are ("access").
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = rb"[A-Za-z0-9+/_.=-]"
LEAST = 16
LABELLED_ROWS = 8000
#: Share of the tokens of a label that begin with a prefix, from which its characters are literal; confidence of a merge; precision of accepted spans.
FREQUENT, ALPHA, PRECISION = 0.01, 0.05, 0.998
#: Prefixes of tokens are counted up to here; longer ones go on in the states they have reached.
DEPTH = 40
#: A token's literal beginning is at most so long.
LITERAL = 16
END = ""
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _table(pattern: bytes) -> np.ndarray:
    return np.array([bool(re.fullmatch(pattern, bytes([b]))) for b in range(256)])


_HEX, _CANDIDATE = _table(rb"[0-9a-f]"), _table(CANDIDATE)


def kind_of(c: str) -> str:
    """The kind of a character, and how many characters are of it: vowels and consonants differ, as words and random strings do."""
    if c.isdigit():
        return "0"
    if c.isalpha():
        kind = "a" if c.lower() in "aeiou" else "k"
        return kind if c.islower() else kind.upper()
    return c


SIZES = {"0": 10, "a": 5, "A": 5, "k": 21, "K": 21}


def labelled(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """(token, secret, fold): credentials and ordinary tokens made by rule, their random parts by hash of the row's number."""
    return secret_forms.table(spark, rows)


class Automaton:
    """A deterministic probabilistic automaton: ``next[state][symbol]``, ``weight[state][symbol]`` and frequent literal prefixes."""

    def __init__(self, prefixes: dict[tuple[str, ...], int], literals: set[str], alpha: float = ALPHA):
        """prefixes: how many tokens begin with these symbols; a final END tells a token that ends there."""
        self.literals = literals
        children: list[dict[str, int]] = [{}]
        counts: list[dict[str, int]] = [{}]
        at: dict[tuple[str, ...], int] = {(): 0}
        for prefix in sorted(prefixes, key=len):
            parent, symbol = at[prefix[:-1]], prefix[-1]
            counts[parent][symbol] = prefixes[prefix]
            if symbol != END:
                at[prefix] = children[parent][symbol] = len(children)
                children.append({})
                counts.append({})
        self._next, self._counts = children, counts
        self._merge(alpha)

    def _differ(self, a: int, b: int, bound: float) -> bool:
        x, y = self._counts[a], self._counts[b]
        n, m = sum(x.values()), sum(y.values())
        if not n or not m:
            return False
        far = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(x.get(s, 0) / n - y.get(s, 0) / m) > far for s in x.keys() | y.keys())

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        left = [(a, b)]
        while left:
            x, y = left.pop()
            if self._differ(x, y, bound):
                return False
            left += [(self._next[x][s], self._next[y][s]) for s in self._next[x].keys() & self._next[y].keys() if self._next[x][s] != self._next[y][s]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """The tree below b into state a, counts and all."""
        left = [(a, b)]
        while left:
            x, y = left.pop()
            for s, n in self._counts[y].items():
                self._counts[x][s] = self._counts[x].get(s, 0) + n
            for s, z in self._next[y].items():
                if s in self._next[x]:
                    left.append((self._next[x][s], z))
                else:
                    self._next[x][s] = z

    def _merge(self, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, seen = [0], {0}
        while True:
            # The states right behind the settled ones, the most frequent first; each is still the root of a tree.
            blue = sorted(((-self._counts[r].get(s, 0), r, s, z) for r in red for s, z in self._next[r].items() if z not in seen))
            if not blue:
                break
            _, r, s, z = blue[0]
            for into in red:
                if self._compatible(into, z, bound):
                    self._next[r][s] = into
                    self._fold(into, z)
                    break
            else:
                red.append(z)
                seen.add(z)
        number = {z: i for i, z in enumerate(red)}
        self.next = [{s: number[z] for s, z in self._next[r].items()} for r in red]
        self.weight = []
        for r in red:
            # One more of every symbol, so that what was never seen is unlikely and not impossible.
            n = sum(self._counts[r].values()) + 16
            known = {s: math.log((c + 1) / n / SIZES.get(s, 1)) for s, c in self._counts[r].items()}
            self.weight.append((known, math.log(1 / n / 20)))
        del self._next, self._counts

    def score(self, token: str) -> float:
        """Log likelihood of the token's format."""
        state, total, prefix = 0, 0.0, ""
        literal = True
        for c in token:
            if literal:
                prefix += c
                literal = prefix in self.literals
            symbol = "'" + c if literal else kind_of(c)
            known, other = self.weight[state]
            total += known.get(symbol, other)
            state = self.next[state].get(symbol, state)
        known, other = self.weight[state]
        return total + known.get(END, other)


def symbols(token: str, literals: set[str]) -> tuple[str, ...]:
    """A token's symbols: literals along a frequent prefix, then kinds; END closes it where it is not longer than DEPTH."""
    n = 0
    while n < len(token) and token[: n + 1] in literals:
        n += 1
    out = [*("'" + c for c in token[:n]), *map(kind_of, token[n:DEPTH])]
    return (*out, END) if len(token) <= DEPTH else tuple(out)


def inferred(tokens: DataFrame, *, frequent: float = FREQUENT, alpha: float = ALPHA) -> Automaton:
    """The automaton of a table (token) of at most some thousand rows; Spark counts its prefixes."""
    n = tokens.count()
    starts = tokens.select("token", F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(LITERAL)))).alias("k")).select(F.expr("substring(token, 1, k)").alias("p"))
    literals = {r.p for r in starts.groupBy("p").count().where(F.col("count") >= max(2, frequent * n)).collect()}

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["\x1f".join(s[:k]) + ("\x1e" if s[k - 1] == END else "") for t in b.column(0).to_pylist() for s in [symbols(t, literals)] for k in range(1, len(s) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["prefix"])

    counted = tokens.select("token").mapInArrow(prefixes, "prefix string").groupBy("prefix").count().collect()  # at most LABELLED_ROWS * (DEPTH + 1)
    return Automaton({tuple(r["prefix"].removesuffix("\x1e").split("\x1f")): r["count"] for r in counted}, literals, alpha)


class Model:
    """Automata of credentials and of ordinary tokens, and the margin per character from which a token is a credential."""

    def __init__(self, secret: Automaton, plain: Automaton, threshold: float):
        self.secret, self.plain, self.threshold = secret, plain, threshold

    def margin(self, token: str) -> float:
        return (self.secret.score(token) - self.plain.score(token)) / math.sqrt(len(token) + 1)


def trained(table: DataFrame, *, precision: float = PRECISION) -> Model:
    """A model from (token, secret, fold): automata from folds 1 to 4, the threshold from fold 0."""
    learn = table.where("fold <> 0")
    model = Model(inferred(learn.where("secret = 1")), inferred(learn.where("secret = 0")), math.inf)
    held = sorted(((model.margin(r.token), r.secret) for r in table.where("fold = 0").select("token", "secret").collect()), reverse=True)
    right = 0
    for i, (m, y) in enumerate(held, 1):
        right += y
        if right / i >= precision and (i == len(held) or held[i][0] < m):
            model.threshold = m if i == len(held) else (m + held[i][0]) / 2
    return model


def _runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` true values, as (start, end), by doubling."""
    have, long = 1, member
    while have < least:
        step = min(have, least - have)
        long = long[: len(long) - step] & long[step:] if len(long) > step else np.zeros(0, bool)
        have += step
    if not long.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
    return [(int(s), int(e) + least - 1) for s, e in edges.reshape(-1, 2)]


def _base(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base spans, in bytes."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text.translate(_LOWER)) if m.end(1) - m.start(1) >= LEAST_VALUE]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(s, e, "hex") for s, e in hexes]


_MIXED = re.compile(rb"[A-Za-z].*?[0-9]|[0-9].*?[A-Za-z]", re.S)


def _added(text: bytes, runs: list[tuple[int, int]], base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str, float]]:
    out = []
    for s, e in runs:
        # Marks around a token belong to the sentence; "=" at its end may be padding.
        token = text[s:e].rstrip(b".-/")
        e = s + len(token)
        token = token.lstrip(b".=-/")
        s = e - len(token)
        if len(token) < LEAST or not _MIXED.search(token) or any(x < e and s < y for x, y, _ in base):
            continue
        margin = model.margin(token.decode())
        if margin >= model.threshold:
            out.append((s, e, "credential", margin))
    return out


def _pieces(member: np.ndarray, least: int, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs by row, in bytes of the row: runs over all texts of a batch, cut where a text ends."""
    found: dict[int, list[tuple[int, int]]] = {}
    for s, e in _runs(member, least):
        row = int(np.searchsorted(offsets, s, "right")) - 1
        while s < e:
            end = min(e, int(offsets[row + 1]))
            if end - s >= least:
                found.setdefault(row, []).append((s - int(offsets[row]), end - int(offsets[row])))
            s, row = max(s, end), row + 1
    return found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]))


def _found(texts: pa.Array, model: Model) -> pa.Array:
    """The spans of each text, by start and kind, in code points."""
    data = pa.concat_arrays([texts]).cast(pa.large_binary())
    data = data.fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if data.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hexes, runs = _pieces(_HEX[raw], LEAST_HEX, offsets), _pieces(_CANDIDATE[raw], LEAST, offsets)
    whole, out = raw.tobytes(), []
    for i in range(len(data)):
        text = whole[offsets[i] : offsets[i + 1]]
        base = _base(text, hexes.get(i, []))
        spans = [(*b, 1.0) for b in base] + _added(text, runs.get(i, []), base, model)
        if spans and not text.isascii():
            point = lambda n, t=text: len(t[:n].decode())
            if len(spans) > 8:
                count = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                point = lambda n, c=count: int(c[n])
            spans = [(point(s), point(e), k, m) for s, e, k, m in spans]
        spans.sort(key=lambda x: (x[0], ALL_KINDS.index(x[2])))
        out.append([{"start": s, "end": e, "kind": k, "base": k in KINDS, "score": m} for s, e, k, m in spans])
    return pa.array(out, _SPANS)


def _scan(model: Model, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @returning
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("spans", _found(b.column(b.schema.get_field_index(text_col)), model))

    return scan


def scanned(docs: DataFrame, model: Model | None = None, *, text_col: str = "text") -> DataFrame:
    """All columns and ``spans``, an array of (start, end, kind, base, score) by start and kind; base spans have score 1."""
    model = model or trained(labelled(docs.sparkSession))
    rows = docs.drop("spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(_scan(model, text_col), ", ".join([*fields, "spans array<struct<start:bigint,end:bigint,kind:string,base:boolean,score:double>>"]))


def digests(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and the digest of base spans, and all spans."""
    found = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)

    def told(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
