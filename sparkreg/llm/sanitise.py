"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card numbers and phone numbers of the texts, and secrets: runs of
20 letters and digits or more that mix both and carry at least 60 bits by the Shannon entropy of their characters. An entity
stands for itself and for coarser classes: its kind, and a domain, a /16 network, the first six digits of a card or the first
four of a phone number. A term t of a document discloses a class c as far as their pointwise mutual information over the
whole corpus, PMI(c; t) = log(N n(c,t) / (n(c) n(t))), comes near the class's own information IC(c) = log(N / n(c)); each n
counts documents (rows) that hold the term anywhere, an entity of the class, or both. Where PMI / IC reaches
``generalise_at`` the term is generalised to its first letters, and from ``remove_at`` it is removed, wherever it stands, also
in documents without the entity. A class, a term and a pair of them need ``support`` different texts, so copies of one text
are no evidence.

Passes: texts with entities give classes and terms; pairs are counted by partial aggregates after classes and terms without
support have gone; pairs that stay below ``generalise_at`` even if the term stood in no other text go next; what is left is
counted over all texts. Tasks know the terms sought while there are at most ``max_terms`` of them; beyond that, terms are
joined by a shuffle instead, with equal results.

Positions are code points, end exclusive. Defined cases: null text is empty and has no spans; texts of any length are read
whole; a match that fails its check (part above 255, digits, Luhn sum) is dropped and not tried again from within; spans
that begin together are written in the order email, ip, card, phone, secret, term; rows that repeat an id and text count as
documents of their own and get equal results; other columns are ignored whatever their names, and kept by
``sanitised_docs``; ids of any type are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise
from sparkreg.llm.shingles import TEXTS

KINDS = ("email", "ip", "card", "phone")
ORDER = (*KINDS, "secret", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}")
Span = tuple[int, int, str]


def emails(text: str) -> Iterator[Span]:
    """Every @ has one possible match: the longest run before it, not before the last match's end. Linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        left = text[low:at]
        start = at - (len(left) - len(left.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if found:
            yield start, found.end(), "email"
            low = found.end()
        at = text.find("@", max(low, at + 1))


def ips(text: str) -> Iterator[Span]:
    """Matches take the parts of a dotted run of numbers four by four."""
    for run in _DOTTED.finditer(text):
        parts, start = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end, "ip"
            start = end + 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                yield m.start(), m.end(), "phone"


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as in KINDS."""
    found = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [*ips(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def secrets(text: str) -> Iterator[Span]:
    """Runs of letters and digits that are too rich in information to be words or numbers."""
    for m in _OPAQUE.finditer(text):
        run = m.group()
        if not run.isdigit() and not run.isalpha():
            bits = sum(n * log2(len(run) / n) for n in Counter(run).values())
            if bits >= 60:
                yield m.start(), m.end(), "secret"


def protected(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and secrets); what lies within a base span is no secret of its own."""
    base = base_spans(text)
    more = [s for s in secrets(text) if not any(s[0] < e and a < s[1] for a, e, _ in base)]
    return base, sorted([*base, *more], key=lambda s: (s[0], ORDER.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def classes(kind: str, value: str) -> Iterator[str]:
    """The classes that an entity stands for, from coarse to fine."""
    yield kind
    digits = "".join(_DIGIT.findall(value))
    coarse = {"email": value.rpartition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}
    if kind in coarse:
        yield f"{kind} of {coarse[kind].lower()}"
    yield f"{kind} {value.lower()}"


def terms_of(text: str, spans: list[Span]) -> Iterator[Span]:
    """(start, end, term) of every term outside the spans, which are in order."""
    at = 0
    for m in _TERM.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if not any(a < end and start < e for a, e, _ in spans[at : at + len(ORDER)]):
            yield start, end, m.group().lower()


def entity_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, classes, terms, copies) of every different text that holds a protected entity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, words = [], [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                spans = protected(text)[1]
                if spans:
                    keys.append(key.as_py())
                    own.append(sorted({c for a, e, kind in spans for c in classes(kind, text[a:e])}))
                    words.append(sorted({t for _, _, t in terms_of(text, spans)}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string()))], names=["key", "classes", "terms"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(scan, "key binary, classes array<string>, terms array<string>")
    found = materialise(found, "entity-rows", TEXTS)
    return found.groupBy("key").agg(F.first("classes").alias("classes"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("copies"))


def _few(terms: DataFrame, max_terms: int) -> list | None:
    """The rows of a materialised table of terms if they are at most max_terms."""
    return terms.collect() if terms.limit(max_terms + 1).count() <= max_terms else None


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str, max_terms: int) -> DataFrame:
    """(term, n_t): documents that hold each of terms outside their spans. Tasks send one count a term."""
    few = _few(terms, max_terms)
    known = None if few is None else docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value if known else None
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                text = text or ""
                n.update({t for _, _, t in (terms_of(text, protected(text)[1]) if wanted is None or _may_hold(text, wanted) else ()) if wanted is None or t in wanted})
            yield pa.RecordBatch.from_pydict({"term": list(n), "n": list(n.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term string, n long")
    if few is None:
        parts = parts.join(terms, "term", "left_semi")
    return parts.groupBy("term").agg(F.sum("n").alias("n_t"))


def _may_hold(text: str, wanted: frozenset) -> bool:
    """Whether any term of text is wanted; a quick look without places."""
    low = text.lower()
    return len(low) != len(text) or not wanted.isdisjoint(_TERM.findall(low))


def _disclosure(n: int, n_t: str) -> Column:
    """PMI of class and term over IC of the class."""
    whole = F.lit(float(n))
    return F.log(whole * F.col("n_ct") / (F.col("n_c") * F.col(n_t))) / F.log(whole / F.col("n_c"))


def disclosing_pairs(docs: DataFrame, *, generalise_at: float = 0.9, remove_at: float = 0.98, support: int = 5, text_col: str = "text", max_terms: int = 300_000) -> DataFrame:
    """(class, term, n_ct, n_c, n_t, disclosure, action) of the pairs that reach a threshold."""
    n = docs.count()
    texts = materialise(entity_texts(docs, text_col), "entity-texts")
    enough = lambda rows, key, name: rows.groupBy(key).agg(F.sum("copies").alias(name), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts")
    kinds = materialise(enough(texts.select(F.explode("classes").alias("class"), "copies"), "class", "n_c").where(F.col("n_c") < n), "classes")
    terms = materialise(enough(texts.select(F.explode("terms").alias("term"), "copies"), "term", "e_t"), "terms")
    own = texts.select("key", F.explode("classes").alias("class")).join(bounded_broadcast(kinds.select("class")), "class", "left_semi")
    own = own.groupBy("key").agg(F.collect_list("class").alias("own")).withColumnRenamed("key", "k")  # a few a text
    met = texts.join(own, F.col("key") == F.col("k")).select("copies", "own", F.explode("terms").alias("term"))
    met = met.join(bounded_broadcast(terms.select("term")), "term", "left_semi").select("copies", "term", F.explode("own").alias("class"))
    pairs = met.groupBy("class", "term").agg(F.sum("copies").alias("n_ct"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    pairs = pairs.join(bounded_broadcast(kinds), "class").join(bounded_broadcast(terms), "term").where(_disclosure(n, "e_t") >= generalise_at)
    pairs = materialise(pairs.drop("texts", "e_t"), "pairs")
    counts = term_counts(docs, materialise(pairs.select("term").distinct(), "pair-terms"), text_col, max_terms)
    rated = pairs.join(counts, "term").withColumn("disclosure", _disclosure(n, "n_t")).where(F.col("disclosure") >= generalise_at)
    return rated.withColumn("action", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise"))


_MARKS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("action", pa.string())]))
_MARK_TYPE = "array<struct<s: int, e: int, action: string>>"


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_terms: int = 300_000, flagged: DataFrame | None = None, **thresholds) -> DataFrame:
    """(doc_id, key, n_email, n_ip, n_card, n_phone, n_secret, n_terms, n_spans, base_sha256, spans, terms) of every row.

    spans has the base spans, the secrets and the disclosing terms, by start; terms is an array of (s, e, action). key is
    the text's MD5. flagged: (term, action) found before; else they are found here.
    """
    if flagged is None:
        pairs = disclosing_pairs(docs, text_col=text_col, max_terms=max_terms, **thresholds)
        flagged = materialise(pairs.groupBy("term").agg(F.max("action").alias("action")), "flagged")  # remove over generalise
    few = _few(flagged, max_terms)
    known = docs.sparkSession.sparkContext.broadcast({r.term: r.action for r in few or []})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    if few is None:
        rows = rows.join(_joined_marks(rows, flagged), F.col("key") == F.col("k"), "left").drop("k")
    else:
        rows = rows.withColumn("marks", F.lit(None).cast(_MARK_TYPE))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actions = known.value
        sought = frozenset(actions)
        for batch in batches:
            found, marks = [], []
            for text, joined in zip(batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                base, spans = protected(text)
                found.append((base, spans))
                if joined.is_valid:
                    marks.append(joined.as_py())
                else:
                    marks.append([{"s": a, "e": e, "action": actions[t]} for a, e, t in terms_of(text, spans) if t in actions] if actions and _may_hold(text, sought) else [])
            counts = [Counter(k for _, _, k in spans) for _, spans in found]
            bases = [written(base) for base, _ in found]
            every = [written(sorted([*spans, *((m["s"], m["e"], "term") for m in ms)], key=lambda s: (s[0], ORDER.index(s[2])))) for (_, spans), ms in zip(found, marks, strict=True)]
            numbers = [*([c[k] for c in counts] for k in (*KINDS, "secret")), list(map(len, marks)), [len(s) + len(m) for (_, s), m in zip(found, marks, strict=True)]]
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in numbers), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in bases], pa.string()), pa.array(every, pa.string()), pa.array(marks, _MARKS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", *_NUMBERS, "base_sha256", "spans", "terms"])

    return rows.mapInArrow(scan, f"doc_id {kind}, key string, {', '.join(f'{c} long' for c in _NUMBERS)}, base_sha256 string, spans string, terms {_MARK_TYPE}")


_NUMBERS = (*(f"n_{k}" for k in KINDS), "n_secret", "n_terms", "n_spans")


def _joined_marks(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """(k, marks) of each different text, for more flagged terms than tasks should know: terms meet them by a shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                at = list(terms_of(text, protected(text)[1]))
                yield pa.RecordBatch.from_pydict({"k": [key.as_py()] * len(at), "s": [a for a, _, _ in at], "e": [e for _, e, _ in at], "term": [t for _, _, t in at]}, schema=pa.schema([("k", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("term", pa.string())]))

    met = rows.select("key", "text").mapInArrow(cut, "k string, s int, e int, term string").join(flagged, "term")
    return met.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("s", "e", "action"))).alias("marks"))  # bounded by one text


def coarser(term: str) -> str:
    """A general form: the first third of the letters, one at least, which many words begin with."""
    return term[: max(1, len(term) // 3)] + "*"


def masked(text: str, spans: str, actions: dict[tuple[int, int], str] | None = None) -> str:
    """text with entities replaced by their kind; terms are removed or, where the action says so, generalised."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, start, end = item.split(":")
        start, end = int(start), int(end)
        if start < at:
            continue
        if kind != "term":
            new = f"[{kind.upper()}]"
        else:
            new = coarser(text[start:end]) if (actions or {}).get((start, end)) == "generalise" else ""
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def sanitised_docs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_terms: int = 300_000, **settings) -> DataFrame:
    """docs with the text masked; null stays null. All columns are kept."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = sanitise(whole, id_col="row", text_col="text", max_terms=max_terms, **settings).select(F.col("doc_id").alias("row"), "spans", "terms")

    @F.pandas_udf("string")
    def mask(text, spans, terms):
        import pandas as pd

        return pd.Series([t if t is None or not s else masked(t, s, {(x["s"], x["e"]): x["action"] for x in a}) for t, s, a in zip(text, spans, terms, strict=True)])

    kinds = docs.schema[text_col].dataType
    new = F.when(F.col("spans") == "", F.col(f"row.`{text_col}`")).otherwise(mask(F.col(f"row.`{text_col}`").cast("string"), "spans", "terms").cast(kinds))
    return marked.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
