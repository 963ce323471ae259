"""Personal data by a skip-chain conditional random field over each whole document.

Base spans come from fixed patterns and always stay. The field labels *candidate* tokens
(white-space words with a digit or ``@``; every other word is O) with O or one of the kinds:

* node potentials from the token's shape and its neighbours' shapes,
* chain potentials between candidates that follow one another,
* skip potentials between distant places that are the same up to punctuation: equal addresses
  or equal digit strings, of one token or of several neighbours, and of a phone number also
  without its country code. Occurrences are linked in order, one to the next, so that m repeats
  make m - 1 pairs of places (each token of either place is linked to the first one of the
  other). Short and long digit strings have potentials of their own.

Tokens of base spans are observed. Loopy belief propagation passes messages until they
settle; runs of other tokens whose label has a posterior over ``least`` become added spans:
say, a number that is written elsewhere in the document in a form that a pattern matches.

All potentials are trained piecewise from counts over all documents, with the base spans as
labels; a token without one that is linked to a token with one has no known label and isn't
counted. The counts are grouped by shape, of which there is a fixed number.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Settings:
    least: float = 0.9          #: posterior of an added token
    rounds: int = 20            #: of message passing at most
    min_digits: int = 6         #: of digit strings of one token that are linked
    run_digits: int = 7         #: of digit strings of several tokens, and without country code
    long_digits: int = 9        #: from here on a string is a long one


# fixed values: the base patterns (possessive forms of the same languages, linear on any text)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> list[Span]:
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((start, 0, floor))
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The pattern matches that pass their checks, by start, then kind."""
    out = _emails(text) if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- the field -------------------------------------------------------------------------

#: sizes of the shape's parts: @, dots, digits, plus, bracket, hyphens, luhn, octets, before, after
_SIZES = (2, 5, 8, 2, 2, 3, 2, 2, 4, 4)
_AT = np.cumsum([0, *_SIZES])
LABELS = 1 + len(KINDS)


def _class(token: str | None) -> int:
    """Shape class of a neighbour: none, word, number, address."""
    if token is None:
        return 0
    return 3 if "@" in token else 2 if _SOME.search(token) else 1


def _shape(token: str, before: str | None, after: str | None) -> tuple[int, ...]:
    d = _digits(token)
    n = len(d)
    core = token.strip(".,;:!?()[]\"'")
    dots = min(core.count("."), 4)
    return (int("@" in token), dots, (n > 0) + (n > 3) + (n > 4) + (n > 6) + (n > 9) + (n > 13) + (n > 19),
            int(token[0] == "+"), int("(" in token), min(core.count("-"), 2),
            int(14 <= n <= 19 and luhn(d)), int(dots == 3 and n >= 4 and bool(re.fullmatch(r"[0-9.]+", core)) and _octets(core)),
            _class(before), _class(after))


def _key(token: str, least: int) -> str | None:
    """What similar tokens share: an address in small letters, or the digits."""
    if "@" in token:
        return token.strip(".,;:!?()[]<>\"'").lower()
    d = _digits(token)
    return d if len(d) >= least else None


_NUMERIC = re.compile(r"[0-9()+.,;:/-]+")
MOST_TOKENS, MOST_DIGITS, COUNTRY_DIGITS = 6, 19, 3  # of a string over several tokens; of a country code

Place = tuple[int, int, str]  # first and last token, key


def _runs(tokens: list[str], follows: set[int], s: Settings) -> list[Place]:
    """The digit strings of two or more neighbouring numeric tokens."""
    numeric = [bool(_NUMERIC.fullmatch(t)) for t in tokens]
    digits = [_digits(t) if n else "" for t, n in zip(tokens, numeric, strict=True)]
    out = []
    for i in range(len(tokens)):
        key, j = digits[i], i + 1
        while numeric[i] and j < min(len(tokens), i + MOST_TOKENS) and j in follows and numeric[j]:
            key += digits[j]
            if len(key) > MOST_DIGITS:
                break
            if len(key) >= s.run_digits:
                out.append((i, j, key))
            j += 1
    return out


def _links(places: list[Place], s: Settings) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links of each place to the latest earlier one of its key: of short and of long keys."""
    short, long = {}, {}  # ordered sets
    latest: dict[str, Place] = {}
    for place in sorted(places, key=lambda p: (p[1], p[0])):
        first, last, key = place
        if key in latest and latest[key][1] >= first:
            continue  # overlaps the one before: not another occurrence
        if key in latest:
            to = long if "@" in key or len(key) >= s.long_digits else short
            a, b, _ = latest[key]
            to.update({(a, k): None for k in range(first, last + 1)} | {(k, first): None for k in range(a, b + 1)})
        latest[key] = place
    return [x for x in short if x not in long], list(long)


@dataclass
class Graph:
    """Candidates of a document: places, observed labels (0: none), shapes, chain and skip links."""
    places: list[tuple[int, int]]
    seen: np.ndarray
    shapes: list[tuple[int, ...]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    long_skip: list[tuple[int, int]]


def graph(text: str, spans: list[Span], s: Settings) -> Graph:
    tokens, places, shapes, chain = [], [], [], []
    before, last = None, -2
    it = list(_TOKEN.finditer(text))
    for k, m in enumerate(it):
        token = m[0]
        if _SOME.search(token):
            after = it[k + 1][0] if k + 1 < len(it) else None
            if last == k - 1:
                chain.append((len(tokens) - 1, len(tokens)))
            tokens.append(token)
            places.append(m.span())
            shapes.append(_shape(token, before, after))
            last = k
        before = token
    keyed = [(k, k, key) for k, token in enumerate(tokens) if (key := _key(token, s.min_digits))]
    keyed += _runs(tokens, {y for _, y in chain}, s)
    seen = np.zeros(len(tokens), np.int64)
    starts = [a for a, _ in places]
    for a, kind, b in spans:
        k = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
        own = []
        while k < len(places) and places[k][0] < b:
            if places[k][1] > a:
                own.append(k)
                if not seen[k]:
                    seen[k] = kind + 1
            k += 1
        if own and KINDS[kind] == "phone":
            d = _digits(text[a:b])
            keyed += [(own[0], own[-1], d[c:]) for c in range(COUNTRY_DIGITS + 1) if len(d) - c >= s.run_digits]
    return Graph(places, seen, shapes, chain, *_links(keyed, s))


@dataclass
class Field:
    """Trained potentials: node weights (shape parts x labels), matrices of the three kinds of links (logs)."""
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    long_skip: np.ndarray

    def nodes(self, shapes: list[tuple[int, ...]]) -> np.ndarray:
        return self.node[np.array(shapes) + _AT[:-1]].sum(axis=1)


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def marginals(field: Field, g: Graph, rounds: int) -> np.ndarray:
    """Posteriors of each candidate's label by loopy sum-product; observed ones are certain."""
    local = _normal(field.nodes(g.shapes))
    local = np.where(g.seen[:, None] > 0, np.eye(LABELS)[g.seen], local)
    links = [*g.chain, *g.skip, *g.long_skip]
    if not links:
        return local
    a, b = np.array([x for x, _ in links] + [y for _, y in links]), np.array([y for _, y in links] + [x for x, _ in links])
    forth = np.concatenate([np.repeat(m[None], n, axis=0) for m, n in (
        (np.exp(field.chain), len(g.chain)), (np.exp(field.skip), len(g.skip)), (np.exp(field.long_skip), len(g.long_skip)))])
    pot = np.concatenate([forth, forth.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    msg = np.full((len(a), LABELS), 1 / LABELS)
    log_local = np.log(local + 1e-12)
    for _ in range(rounds):
        total = log_local.copy()
        np.add.at(total, b, np.log(msg))
        out = _normal(total[a] - np.log(msg[back]))
        new = np.einsum("ei,eij->ej", out, pot)
        new = 0.5 * msg + 0.5 * new / new.sum(axis=1, keepdims=True)
        moved, msg = np.abs(new - msg).max(), new
        if moved < 1e-4:
            break
    total = log_local.copy()
    np.add.at(total, b, np.log(msg))
    return _normal(total)


def added_spans(text: str, base: list[Span], field: Field, s: Settings) -> list[Span]:
    g = graph(text, base, s)
    if not len(g.seen) or g.seen.all():
        return []
    p = marginals(field, g, s.rounds)
    label = np.where((g.seen == 0) & (p.argmax(axis=1) > 0) & (p.max(axis=1) >= s.least), p.argmax(axis=1), 0)
    follows = {y for _, y in g.chain}
    out, k = [], 0
    while k < len(label):
        if not label[k]:
            k += 1
            continue
        end = k + 1
        while end < len(label) and label[end] == label[k] and end in follows:
            end += 1
        a, b = g.places[k][0], g.places[end - 1][1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b and not any(x < b and a < y for x, _, y in base):
            out.append((a, int(label[k]) - 1, b))
        k = end
    return out


# ---- training --------------------------------------------------------------------------

def _tally(text: str, s: Settings) -> Counter:
    base = base_spans(text)
    g = graph(text, base, s)
    n: Counter = Counter()
    seen = g.seen.tolist()
    known = [y > 0 for y in seen]  # or linked to one that is
    skips = sorted({*g.skip, *g.long_skip}, key=lambda x: x[1])
    for i, j in [*skips, *reversed(skips)]:
        known[i] = known[j] = known[i] or known[j]
    for shape, y, k in zip(g.shapes, seen, known, strict=True):
        if y or not k:
            n["n", int(np.ravel_multi_index(shape, _SIZES)), y] += 1
    for i, j in g.chain:
        n["c", seen[i], seen[j]] += 1
    for what, links in (("s", g.skip), ("l", g.long_skip)):
        for i, j in links:
            if seen[i] and seen[j]:
                n[what, seen[i], seen[j]] += 1
    return n


def counts(docs: DataFrame, s: Settings) -> DataFrame:
    """(what, a, b, n): shapes by label, and labels at both ends of links, over all documents."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                text = t.as_py()
                if text and _SOME.search(text):
                    total.update(_tally(text, s))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
            pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], names=["what", "a", "b", "n"])
    rows = C.only(docs, "text").mapInArrow(task, "what string, a long, b long, n long")
    return rows.groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def _fit_nodes(shapes: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Multinomial logistic fit over distinct shapes with counts (full gradient, Adam)."""
    w = np.zeros((_AT[-1], LABELS))
    cols = shapes + _AT[:-1]
    n = n / n.sum()
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 601):
        p = _normal(w[cols].sum(axis=1))
        p[np.arange(len(y)), y] -= 1
        g = 1e-5 * w
        np.add.at(g, cols, np.repeat((p * n[:, None])[:, None, :], cols.shape[1], axis=1))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.05 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-9)
    return w


def _agreement(n: np.ndarray, most: float = 5.0) -> np.ndarray:
    """Log potential of a link: the log odds of equal labels where one end is not O, 0 to ``most``."""
    some = n.copy()
    some[0, 0] = 0
    same = np.trace(some)
    w = float(np.clip(np.log((same + 10) / (some.sum() - same + 1)), 0, most))
    return w * np.eye(LABELS)


def train(docs: DataFrame, s: Settings) -> Field:
    """Piecewise training from the grouped counts (at most one row per shape and label)."""
    rows = sorted(map(tuple, counts(docs, s).collect()))
    links = {what: np.zeros((LABELS, LABELS)) for what in "csl"}
    for what, a, b, n in rows:
        if what in links:
            links[what][a, b] += n
    nodes = [r for r in rows if r[0] == "n"]
    if nodes:
        shapes = np.stack(np.unravel_index([r[1] for r in nodes], _SIZES), axis=1)
        node = _fit_nodes(shapes, np.array([r[2] for r in nodes]), np.array([r[3] for r in nodes], float))
    else:
        node = np.zeros((_AT[-1], LABELS))
        node[:, 0] = 1.0
    return Field(node, _agreement(links["c"]), _agreement(links["s"]), _agreement(links["l"], 8.0))


def find(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` columns doc_id, text with ``spans`` (array of start, end, kind, base) and the digest.

    Null texts are empty; they and texts without a digit or ``@`` have no span. Repeated rows
    get a row each; a null doc_id stays. An empty table gives no rows; columns besides doc_id
    and text are ignored.
    """
    s = settings or Settings()
    ship_package(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, s))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n, digest, spans, new = [[] for _ in KINDS], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text) if _SOME.search(text) else []
                more = added_spans(text, base, field, s) if _SOME.search(text) else []
                for k, col in enumerate(n):
                    col.append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(shown(base).encode()).hexdigest() if base else none)
                spans.append(shown(sorted(base + more)))
                new.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(new, pa.int64())],
                names=names)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(task, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` with every span found in ``text`` masked; the other columns as they were.

    Null texts stay null; texts without spans are unchanged. Every row stays, repeated ones and
    ones with a null doc_id too; an empty table gives no rows.
    """
    s = settings or Settings()
    ship_package(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, s))
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for rows in batches:
            for batch in C.slices(rows):
                texts = []
                for t in batch.column(place):
                    text = t.as_py()
                    if text and _SOME.search(text):
                        base = base_spans(text)
                        text = mask(text, base + added_spans(text, base, field, s))
                    texts.append(text)
                cols = list(batch.columns)
                cols[place] = pa.array(texts, cols[place].type)
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
    return docs.mapInArrow(task, docs.schema)
