"""Personal data (operator 6): patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and are never taken back. Added kinds are proposed by wider
patterns and reported only when their score, after checksum and context, reaches ``MIN_SCORE``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

# Base patterns. A match cannot begin inside a run of the characters that its first part takes, so each pattern is
# tried at the beginning of a run only; this keeps long runs linear and changes no match.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3,5}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9-]|\.[0-9])")

# Words near a span that speak for its kind. Fixed values.
CONTEXT = {
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta", "transfer", "bic", "swift"},
    "ssn": {"ssn", "social", "security", "taxpayer", "tax"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "telefono", "teléfono",
                    "téléphone", "handy", "contact"},
}
CONTEXT_CHARS = 48
START_SCORE = {"iban": 0.4, "ssn": 0.4, "local_phone": 0.3}
CHECKED, CONTEXT_GAIN, MIN_SCORE = 0.5, 0.35, 0.6
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters moved behind, letters as 10 to 35, remainder 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(t: str):
    last, at = 0, t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at)
        if m:
            start = at
            while start > last and (t[start - 1].isascii() and (t[start - 1].isalnum() or t[start - 1] in "._%+-")):
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = t.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ibans(t: str):
    """Confirmed spans from left to right. A proposal may have taken in words or numbers behind the account number: the
    longest part of it that ends where the characters of a group end and passes the checksum counts, and the search
    goes on behind that part. Without one it goes on behind the proposal's first group, for a number that the proposal
    has swallowed."""
    at = 0
    while m := _IBAN.search(t, at):
        a, b = m.span()
        at = a + 4
        for end in range(b, a + 14, -1):
            if end < len(t) and t[end].isascii() and t[end].isalnum() or t[end - 1] == " ":
                continue
            s = t[a:end].replace(" ", "")
            if 15 <= len(s) <= 34 and _IBAN.fullmatch(t, a, end) and mod97(s):
                yield a, end
                at = end
                break


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that pass their check, in order of kind and start."""
    out = [("email", a, b) for a, b in _emails(t)] if "@" in t else []
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _score(kind: str, t: str, start: int, end: int, checked: bool) -> float:
    score = START_SCORE[kind] + (CHECKED if checked else 0.0)
    near = t[max(0, start - CONTEXT_CHARS):start] + " " + t[end:end + CONTEXT_CHARS // 2]
    if any(w.lower() in CONTEXT[kind] for w in _WORD.findall(near)):
        score += CONTEXT_GAIN
    return min(score, 1.0)


def added_spans(t: str, base) -> list[tuple[str, int, int, float]]:
    """Spans of the added kinds; a span of one of these kinds that meets an earlier one of any kind is left out."""
    found = []
    for a, b in _ibans(t):
        found.append(("iban", a, b, _score("iban", t, a, b, True)))
    for m in _SSN.finditer(t):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.append(("ssn", m.start(), m.end(), _score("ssn", t, m.start(), m.end(), False)))
    for m in _LOCAL_PHONE.finditer(t):
        found.append(("local_phone", m.start(), m.end(), _score("local_phone", t, m.start(), m.end(), False)))
    # what is taken, as ranges apart from each other in order: only the last that begins before an end can reach into it
    starts, ends, out = [], [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for k, a, b, s in found:
        i = bisect_left(starts, b)
        if s >= MIN_SCORE and not (i and ends[i - 1] > a):
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((k, a, b, s))
    return out


def find_spans(t: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in KINDS, then start; code points, end exclusive."""
    if not any("0" <= c <= "9" for c in t) and "@" not in t:
        return []
    base = base_spans(t)
    more = sorted(added_spans(t, base), key=lambda s: (KINDS.index(s[0]), s[1]))
    return [(k, a, b, 1.0) for k, a, b in base] + more


def redact_text(t: str, spans) -> str:
    """Spans replaced by their kind in brackets; of overlapping spans the union, named after the first."""
    out, at, merged = [], 0, []
    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [t[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, t[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                 ("score", pa.float64())]))


def _spans_and_text(redact: bool):
    def run(batches):
        for b in batch_slices(batches, "t"):
            texts, spans = b.column("t").to_pylist(), []
            for t in texts:
                spans.append(find_spans(t or ""))
            rows = pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in own] for own in spans], _SPAN_TYPE)
            arrays, names = [*(b.column(n) for n in b.schema.names if n != "t"), rows], \
                [*(n for n in b.schema.names if n != "t"), "spans"]
            if redact:
                arrays.append(pa.array([t if t is None or not s else redact_text(t, s) for t, s in zip(texts, spans)],
                                       pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans`` (kind, start, end, score) of every whole text; null and empty texts have none. One pass, no
    exchange; rows that share an id stay rows of their own."""
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    return src.mapInArrow(_spans_and_text(False), f"i {kind}, spans {SPANS}").withColumnRenamed("i", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in brackets; null texts stay null and all other
    columns keep their names, order and values."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    src = docs.toDF(*names).select(*[n for n in names if n != names[at]], F.col(names[at]).alias("t"))
    kept = [n for n in names if n != names[at]]
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in kept)
    out = src.mapInArrow(_spans_and_text(True), (schema + ", " if schema else "") + f"spans {SPANS}, redacted string")
    return out.select(*[F.col("redacted" if i == at else n).alias(c)
                        for i, (n, c) in enumerate(zip(names, docs.columns))])


def _digest_rows(batches):
    for b in batch_slices(batches, "t"):
        counts, shas, alls = [[] for _ in BASE_KINDS], [], []
        for t in b.column("t").to_pylist():
            spans = find_spans(t or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            for c, k in zip(counts, BASE_KINDS):
                c.append(sum(s[0] == k for s in base))
            shas.append(hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y, _ in base).encode()).hexdigest())
            alls.append(",".join(f"{k}:{x}:{y}" for k, x, y, _ in spans))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()),
             pa.array(alls, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over all of ``documents``: the digests of ``find_spans`` per document."""
    return (spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("t"))
            .mapInArrow(_digest_rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                      "base_sha256 string, spans string"))
