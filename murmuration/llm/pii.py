"""Personal data in texts: fixed patterns, and a semi-Markov random field.

The patterns give the base spans, which always stay. The field looks at the
stretches of text around digits and "@", where candidates are runs of at most
``MAX_TOKENS`` tokens; features describe a candidate as a whole (its shape, its
digits, whether it passes its kind's check) and what stands beside it, and
dynamic programming chooses boundaries and kinds together. It learns from base
spans in stretches where no match was too long for its check, and adds what the
patterns miss: they take the longest match and give it up when that fails, so
two card numbers in a row, or a phone before an address, are lost to them. What
it adds does not overlap base spans and passes the check of its kind.

At most ``MAX_DOCS`` documents (those with the smallest hash of their text) are
learnt from. Null and empty texts have no spans. Texts of any length, and runs of
any length in them, are read whole, in time in proportion to their length. Rows
that repeat an id, or have none, are documents of their own; other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm.common import map_rows, text_of
from murmuration.llm.semicrf import Lattice, SemiCRF

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
MAX_DOCS = 4_000
MAX_STRETCHES = 1_500
CACHED_LATTICES = 20_000

Span = tuple[int, int, str]

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match never starts inside a run of digits, so none is tried there
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]\S*")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_A-Za-z0-9]+|\s+|[^\w\s]|_")
DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The check of a kind, for a text that its pattern matches."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    digits = "".join(DIGITS.findall(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


MOST_DIGITS = {"card": 19, "phone": 15}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``EMAIL``, in time linear in the text: each has one "@", so
    they are found from there, the part before it as far back as it goes."""
    at, end = text.find("@"), 0
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL:
            first -= 1
        if first < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield first, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns by start and kind, and the matches that were given
    up for having too many digits: they may hold several spans."""
    good, failed = [], []
    good += [(a, b, "email") for a, b in emails(text)]
    for kind, pattern in PATTERNS.items():
        if kind == "email" or (kind == "phone" and "+" not in text):
            continue
        for m in pattern.finditer(text):
            if passes(kind, m.group()):
                good.append((m.start(), m.end(), kind))
            elif kind in MOST_DIGITS and sum(map(str.isdigit, m.group())) > MOST_DIGITS[kind]:
                failed.append((m.start(), m.end(), kind))
    good.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return good, failed


def stretches(text: str) -> list[tuple[int, int]]:
    """Pieces without white space that have a digit or "@", joined where one blank
    stands between them."""
    out: list[tuple[int, int]] = []
    floor = 0
    for m in SEED.finditer(text):
        first = m.start()
        while first > floor and not text[first - 1].isspace():
            first -= 1
        if out and first == out[-1][1] + 1 and text[first - 1] == " ":
            out[-1] = out[-1][0], m.end()
        else:
            out.append((first, m.end()))
        floor = m.end()
    return out


def _shape(text: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", DIGITS.sub(lambda m: f"{min(len(m.group()), 20)}d", text)).replace(" ", "_")


def _around(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c


def _features(text: str, a: int, b: int) -> tuple[str, ...]:
    own = text[a:b]
    digits = sum(c.isdigit() for c in own)
    out = ["one", f"left {_around(text, a - 1)}", f"right {_around(text, b)}"]
    for kind, pattern in PATTERNS.items():
        if pattern.fullmatch(own):
            out.append(f"{kind} {'good' if passes(kind, own) else 'bad'}")
    if "@" in own:
        out.append(f"dots {min(own.partition('@')[2].count('.'), 3)}")
        if not own[0].isalnum():
            out.append(f"starts {own[0]}")
    else:
        out += [f"shape {_shape(own)}", f"digits {min(digits, 24)}", f"first {own[0] if not own[0].isdigit() else 'd'}"]
    return tuple(out)


def lattice_of(text: str) -> tuple[Lattice, list[int]]:
    """Candidates of a stretch, and the place in the text of each token's start.

    A candidate begins and ends where its kind can: it has four digits or an "@",
    letters only with "@", and blanks only without."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    places = [a for a, _ in tokens] + [len(text)]
    plain, segments = [], []
    for a, b in tokens:
        own = text[a:b]
        kind = f"{min(b - a, 20)}d" if own.isdigit() else "w" if own.isalnum() else "_" if own.isspace() else own
        plain.append(("one", f"token {kind}"))
    texts = [text[a:b] for a, b in tokens]
    kinds = ["d" if t.isascii() and t.isdigit() else "w" if t.isascii() and t.isalnum() else "x" if t.isalnum() else t for t in texts]
    for i, first in enumerate(kinds):
        if first not in ("d", "w", "+", ".", "_", "%", "-"):
            continue
        digits, at, blank, word = 0, 0, False, False
        for j in range(i, min(i + MAX_TOKENS, len(kinds))):
            kind = kinds[j]
            if kind == "d":
                digits += len(texts[j])
            elif kind == "w":
                word = True
            elif kind == "@":
                at += 1
            elif kind == " ":
                blank = True
            elif kind not in (".", "_", "%", "+", "-", "(", ")"):
                break
            if at > 1 or digits > 40 or (blank and (at or word)):
                break
            if kind in ("d", "w") and (at or (digits >= 4 and not word and first in ("d", "+"))):
                segments.append((i, j + 1, _features(text, places[i], places[j + 1])))
    return Lattice(tuple(plain), tuple(segments)), places


def examples(text: str) -> list[tuple[Lattice, list[Span]]]:
    """Stretches whose base spans are certain, as lattices with right answers."""
    good, failed = base_spans(text)
    out = []
    for a, b in stretches(text):
        if any(x < b and y > a for x, y, _ in failed):
            continue
        lattice, places = lattice_of(text[a:b])
        at = {p: k for k, p in enumerate(places)}
        known = {(i, j) for i, j, _ in lattice.segments}
        gold, sure, end = [], True, 0
        for x, y, kind in good:
            if x < b and y > a:
                i, j = at.get(x - a), at.get(y - a)
                sure &= i is not None and (i, j) in known and i >= end
                end = j or 0
                gold.append((i, j, kind))
        if sure and lattice.segments:
            out.append((lattice, gold))
    return out


class Finder:
    """Base spans, and those that the field adds."""

    def __init__(self, field: SemiCRF | None):
        self.field = field
        self.known: dict[str, list[Span]] = {}

    def __getstate__(self):
        return {"field": self.field, "known": {}}

    def added(self, piece: str) -> list[Span]:
        if piece not in self.known:
            if len(self.known) >= CACHED_LATTICES:
                self.known.clear()
            lattice, places = lattice_of(piece)
            best = self.field.best(lattice) if lattice.segments else []
            spans = [(places[i], places[j], kind) for i, j, kind in best]
            self.known[piece] = [
                (a, b, k) for a, b, k in spans if PATTERNS[k].fullmatch(piece[a:b]) and passes(k, piece[a:b])
            ]
        return self.known[piece]

    def find(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start and kind."""
        text = text or ""
        base, _ = base_spans(text)
        if self.field is None:
            return base, base
        more = []
        for a, b in stretches(text):
            for x, y, kind in self.added(text[a:b]):
                if not any(p < a + y and q > a + x for p, q, _ in base):
                    more.append((a + x, a + y, kind))
        return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def fit_finder(docs: DataFrame, max_docs: int = MAX_DOCS, max_stretches: int = MAX_STRETCHES) -> Finder:
    """Learn from a bounded sample of the documents that have digits or "@"."""
    rows = docs.select(text_of()).filter(F.col("text").rlike("[0-9@]"))
    # only hashes are compared; a text then knows by its own whether it is chosen
    hashes = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(max_docs)
    edge = hashes.agg(F.max("h")).first()[0]
    if edge is None:
        return Finder(None)
    chosen = rows.filter(F.xxhash64("text") <= edge)

    def columns(batch: pa.RecordBatch) -> dict:
        pieces = [[t[a:b] for a, b in stretches(t)] for t in batch.column("text").to_pylist()]
        return {"pieces": pieces}

    found = map_rows(chosen, "pieces array<string>", columns).select(F.explode("pieces").alias("piece")).distinct()
    # whole stretches, of which max_stretches at most reach the driver
    picked = found.filter(F.length("piece") <= 4000).orderBy(F.xxhash64("piece"), "piece").limit(max_stretches)
    made = [e for r in picked.collect() for e in examples(r.piece)]
    return Finder(SemiCRF(KINDS).fit(made) if any(gold for _, gold in made) else None)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame, finder: Finder) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts
    and digest of the base spans, all spans as text, and how many were added."""
    shared = docs.sparkSession.sparkContext.broadcast(finder)  # of bounded training data

    def columns(batch: pa.RecordBatch) -> dict:
        found = [shared.value.find(t) for t in batch.column("text").to_pylist()]
        counts = [Counter(kind for _, _, kind in base) for base, _ in found]
        return {
            "doc_id": batch.column("doc_id"),
            **{f"n_{kind}": [c[kind] for c in counts] for kind in KINDS},
            "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [_joined(every) for _, every in found],
            "n_added": [len(every) - len(base) for base, every in found],
        }

    spec = "doc_id long," + ",".join(f"n_{k} long" for k in KINDS) + ",base_sha256 string,spans string,n_added long"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()), spec, columns)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by the name of its kind; of overlapping
    spans, the one that starts first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])
