"""Personal data: fixed patterns, and unseen identifiers found by bootstrapped contextual extraction.

The matches of four fixed patterns are the seed entities. Candidates are e-mail addresses spelled with
"at" and "dot", numbers of several tokens, and every other token with a digit or an at sign. Seeds and
candidates occur in lexical patterns: one or two words before, one or two words after, or a word on both
sides, together with a coarse class, which tells names from long and short numbers but not how they are
written. Patterns and instances form a graph, which Spark scores in rounds until the scores settle: a
pattern is as trustworthy for a kind as the instances it occurs with, an instance as the patterns it
occurs in. Tokens in patterns of high confidence become spans of that kind.

A pattern's confidence is the lower end of a one-sided interval of nine tenths for the share of its
occurrences that are of the kind, so that a few occurrences never suffice: at the threshold of 0.8 it
takes seven out of seven, which a word that stands before identifiers by chance does not reach. Guesses
alone do not make a pattern trusted: more than half of its occurrences must be seeds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.lineage import cut as written
from tesselon.lineage import remove
from tesselon.llm.common import chunks, cut, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most; they end when no confidence changes by more than ``SETTLED``.
ROUNDS, SETTLED = 10, 0.01
CONFIDENCE, SUPPORT, MAJORITY = 0.8, 5, 0.5
#: The normal distribution's quantile of nine tenths.
_Z = 1.2816
#: Code points of a local part at most, spelled out or not (a fixed value of mail addresses).
_LOCAL_PART = 64
#: Longer context words stand in patterns as their digest.
_LONG_WORD = 64
_WORD = re.compile(r"\S+")
_SPAN = "array<struct<start:int,kind:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run, so looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS, _NOT_DIGIT = re.compile("[0-9]"), re.compile("[0-9]+"), re.compile("[^0-9]+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_LETTER = re.compile(r"[^\W\d_]|@")
_AT = re.compile(r"(?<!\S)at(?!\S)|[\[({<]\s?(?:at|@)\s?[\])}>]|@", re.IGNORECASE)
_BEFORE_AT = re.compile(r"(?<![^\s\"'(<\[{,;:])(?:[\w.%+-]+\sdot\s){0,3}[\w.%+-]+\s{0,2}\Z", re.IGNORECASE)
_MORE_BEFORE = re.compile(r"\sdot\s\Z", re.IGNORECASE)
_AFTER_AT = re.compile(r"\s{0,2}[A-Z0-9-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[A-Z0-9-]{1,63})*(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[A-Z]{2,63}(?![\w@])", re.IGNORECASE)
# A number begins after white space or a sign that no number holds, which keeps long runs linear.
_NUMBER = r"[(\[+]{0,2}+[0-9][0-9().\[\]/+-]*+(?![^\s\"'>},;:!?*#$%&])"
_NUMBERS = re.compile(rf"(?<![^\s\"'<{{,;:!?*#$%&=]){_NUMBER}(?:[^\S\r\n]{{1,2}}(?:[-/][^\S\r\n])?{_NUMBER})+")
#: Digits of a number of several tokens; a token with at least ``_ALONE`` is never joined with others; fewer than ``_LONG`` are a short number.
_LONG, _ALONE, _MOST = 7, 12, 19
_EDGE = "\"'()[]{}<>,;:!?*#$%&"


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match ends its local part at an "@", so every "@" is looked at once, from there to the left."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start, then kind; offsets in code points."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
        out.sort()
    return out


class _Context:
    """The words of one text, found once, and the patterns of places in it."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = [], []
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def _word(self, start: int, end: int) -> str:
        word = self.text[start:end]
        return _DIGITS.sub("0", word.lower()) if len(word) <= _LONG_WORD else "#" + hashlib.md5(word.encode()).hexdigest()

    def patterns(self, start: int, end: int) -> list[str]:
        k = bisect_right(self.starts, start) - 1
        left, right = [], []
        if k >= 0 and self.ends[k] > start:
            if self.starts[k] < start:
                left.append(self._word(self.starts[k], start))
            k -= 1
        while len(left) < 2 and k >= 0:
            left.insert(0, self._word(self.starts[k], self.ends[k]))
            k -= 1
        k = bisect_right(self.ends, end)
        if k < len(self.starts) and self.starts[k] < end:
            right.append(self._word(end, self.ends[k]))
            k += 1
        while len(right) < 2 and k < len(self.starts):
            right.append(self._word(self.starts[k], self.ends[k]))
            k += 1
        filler = self.text[start:end]
        coarse = "name" if _LETTER.search(filler) else "long" if len(_DIGIT.findall(filler)) >= _LONG else "short"
        known = []
        if left:
            known.append(f"{left[-1]} _")
        if right:
            known.append(f"_ {right[0]}")
        if len(left) == 2:
            known.append(f"{left[0]} {left[1]} _")
        if len(right) == 2:
            known.append(f"_ {right[0]} {right[1]}")
        if left and right:
            known.append(f"{left[-1]} _ {right[0]}")
        return [f"{p} | {coarse}" for p in known]


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses with "at" or "dot" in words, in brackets or between blanks."""
    free = 0
    for m in _AT.finditer(text):
        # Looking behind sees what lies before the bound, so a longer local part is no candidate, nor is its end.
        local = _BEFORE_AT.search(text, max(free, m.start() - _LOCAL_PART), m.start())
        domain = local and not _MORE_BEFORE.search(text, max(free, local.start() - 5), local.start()) and _AFTER_AT.match(text, m.end())
        if domain:
            yield local.start(), domain.end()
            free = domain.end()


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of several tokens, from ``_LONG`` to ``_MOST`` digits."""
    for m in _NUMBERS.finditer(text):
        group: list[tuple[int, int, int]] = []
        for token in re.finditer(r"\S*[0-9]\S*|\Z", m[0]):
            digits = len(_DIGIT.findall(token[0]))
            if digits and digits < _ALONE:
                group.append((m.start() + token.start(), m.start() + token.end(), digits))
                continue
            if len(group) > 1 and _LONG <= sum(g[2] for g in group) <= _MOST:
                start, end = group[0][0], group[-1][1]
                while text[end - 1] in ".-/+([":
                    end -= 1
                own = text[start:end]
                if own[0] in "([" and own[-1] in ")]" and sum(map(own.count, "([")) == 1:
                    start, end = start + 1, end - 1
                elif own[0] in "([" and not any(c in own for c in ")]"):
                    start += 1
                elif own[-1] in ")]" and not any(c in own for c in "(["):
                    end -= 1
                yield start, end
            group = []


def _apart(spans: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that overlap none of ``taken``; both by start, spans one after the other."""
    k = reach = 0
    for start, end in spans:
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if start < end and reach <= start:
            yield start, end


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign, without the signs around them."""
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE + ".":
            end -= 1
        yield start, end


def occurrences(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, instance, patterns) of the seeds and of all candidates that overlap none, nor each other."""
    places, taken = [(a, b, kind) for a, kind, b in seeds], sorted((a, b) for a, _, b in seeds)
    for candidates in (_spelled, _numbers, _tokens):
        fresh = list(_apart(candidates(text), taken))
        places += [(a, b, -1) for a, b in fresh]
        taken = sorted(taken + fresh)
    context = _Context(text) if places else None
    return [(a, b, kind, text[a:b].lower(), context.patterns(a, b)) for a, b, kind in places]


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, seen): base spans and occurrences of every whole text; ``h`` names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for part in chunks(batches, "text"):
            base, found = [], []
            for text in part.column("text").to_pylist():
                own = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in own])
                found.append([dict(zip(("start", "end", "kind", "instance", "patterns"), o, strict=True)) for o in occurrences(text, own)])
            yield pa.record_batch([part.column("doc_id"), part.column("h"), pa.array(base, span), pa.array(found, seen)], ["doc_id", "h", "base", "seen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    return keyed.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h long, base {_SPAN}, seen array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>")


def score_graph(edges: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(pattern, kind, confidence, support, seeded) from edges (pattern, instance, kind, n); ``kind`` is -1 unless seeded.

    Patterns that occur once tell nothing and are left out. ``support`` counts the seed instances of the
    kind in the pattern, ``seeded`` is their share of its occurrences. Confidence is the lower end of the
    interval for the share of the pattern's occurrences that its instances' scores account for; a seed's
    score is 1, another instance's the mean confidence of the patterns it occurs in. Rounds end when no
    confidence changes by more than ``settled``, after ``rounds`` at the latest.
    """
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total")).filter("total > 1")
    seeded = written(edges.filter("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("score")))
    seeds = seeded.select("instance", F.lit(True).alias("own")).distinct()
    pairs = written(edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")).join(total, "pattern").join(seeds, "instance", "left"))
    # Only patterns with a seed vote, so scores reach the instances in them and no others.
    reached = pairs.join(pairs.filter("own").select("pattern").distinct(), "pattern", "left_semi").select("instance").distinct()
    degree = pairs.groupBy("instance").agg(F.sum("n").alias("all"))
    weights = written(pairs.join(reached, "instance", "left_semi").join(degree, "instance"), pairs)
    share, n = F.col("hits") / F.col("total"), F.col("total")
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + _Z**2 / (4 * n * n))
    lower = (share + _Z**2 / (2 * n) - _Z * spread) / (1 + _Z**2 / n)
    known, scored = seeded, None
    for _ in range(rounds):
        seed = F.col("score") == 1.0
        sums = F.sum(F.col("n") * F.col("score")).alias("hits"), F.count(F.when(seed, 1)).alias("support"), F.coalesce(F.sum(F.when(seed, F.col("n"))), F.lit(0)).alias("seeds")
        hits = weights.join(known, "instance").groupBy("pattern", "total", "kind").agg(*sums)
        fresh = hits.select("pattern", "kind", lower.alias("confidence"), "support", (F.col("seeds") / F.col("total")).alias("seeded"))
        if scored is None:
            scored = written(fresh.withColumn("before", F.lit(0.0)))
        else:
            scored = written(fresh.join(scored.select("pattern", "kind", F.col("confidence").alias("before")), ["pattern", "kind"], "left"), scored)
        if scored.filter(F.abs(F.col("confidence") - F.coalesce("before", F.lit(0.0))) > settled).isEmpty():
            break
        votes = weights.filter("own IS NULL").join(scored.filter(F.col("support") > 0), "pattern").groupBy("instance", "kind", "all").agg(F.sum(F.col("n") * F.col("confidence")).alias("votes"))
        guessed = votes.select("instance", "kind", (F.col("votes") / F.col("all")).alias("score"))
        known = written(seeded.unionByName(guessed), None if known is seeded else known)
    for table in {id(t): t for t in (weights, seeded, known)}.values():
        remove(edges.sparkSession, table._cut)
    return scored.drop("before")


def _reachable(edges: DataFrame) -> DataFrame:
    """(pattern, kind, support, seeded, most): what is known of a pattern before any round; ``most`` bounds its confidence."""
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total")).filter("total > 1")
    seeds = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("support"), F.sum("n").alias("seeds"))
    return seeds.join(total, "pattern").select("pattern", "kind", "support", (F.col("seeds") / F.col("total")).alias("seeded"), (F.col("total") / (F.col("total") + _Z**2)).alias("most"))


def _extra(scan: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """(doc_id, h, extra): the spans that trusted patterns add, for documents that have any."""
    seen = scan.select("doc_id", "h", F.explode("seen").alias("o")).select("doc_id", "h", "o.start", "o.end", "o.kind", "o.instance", F.explode("o.patterns").alias("pattern"))
    edges = cut(seen.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")))
    # Rounds change neither support nor majority nor the highest confidence that so many occurrences allow.
    able = _reachable(edges).filter((F.col("most") >= confidence) & (F.col("support") >= support) & (F.col("seeded") > MAJORITY))
    if able.isEmpty():
        none = scan.select("doc_id", "h").limit(0)
        return none.withColumn("extra", F.array().cast(_SPAN))
    trusted = score_graph(edges, rounds).filter((F.col("confidence") >= confidence) & (F.col("support") >= support) & (F.col("seeded") > MAJORITY))
    found = seen.filter("kind < 0").drop("kind").join(trusted, "pattern").groupBy("doc_id", "h", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def find(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every whole text.

    The counts and ``base_sha256`` cover the fixed patterns' spans; ``spans`` holds all spans as
    kind:start:end by start, then kind, in code points with exclusive ends; ``n_found`` is how many
    the method added. Null texts count as empty: no spans, the digest of the empty text. Rows that
    repeat id and text get the same spans. Null ids stay; an empty table gives an empty result; other
    columns are ignored.
    """
    scan = cut(_scan(docs))
    # A table has a size by which Spark decides whether to send it to all tasks.
    extra = written(_extra(scan, rounds, confidence, support).select(F.col("doc_id").alias("d"), F.col("h").alias("e"), "extra"))
    joined = scan.join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e")), "left")
    none = F.array().cast(_SPAN)
    # One argument only: a second one would be an element's position.
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", F.coalesce("extra", none)))
    return joined.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_found"))


def mask(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in angle brackets; null texts stay null.

    The columns stay those of ``docs``; where there is an ``n_chars`` it is that of the new text.
    """
    scan = cut(_scan(docs))
    extra = written(_extra(scan, rounds, confidence, support).select(F.col("doc_id").alias("__d"), F.col("h").alias("__e"), F.col("extra").alias("__extra")))
    joined = docs.join(extra, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(text_or_empty()) == F.col("__e")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = [t if t is None else _masked(t, x) for t, x in zip(part.column("text").to_pylist(), part.column("__extra").to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
            yield pa.record_batch(columns, names)

    names = docs.columns
    out = joined.select(*names, "__extra").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _masked(text: str, extra: list[dict] | None) -> str:
    spans = sorted([*base_spans(text), *((s["start"], s["kind"], s["end"]) for s in extra or [])])
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
