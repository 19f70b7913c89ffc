"""Personal data by weak supervision.

Four base patterns (email, ip, card, phone) always give spans. Wider patterns propose more candidates:
written-out mail addresses, phone numbers without a plus sign or run together with other digits, cards and
addresses with other separators or after other digits.
Labelers vote on every candidate, base or wide: a strict shape (regex), a check (Luhn, parts, digit counts), a
gazetteer (top-level domains, card and dialling prefixes, reserved networks), and words of context for
and against. Expectation-maximisation over the counted vote patterns of the whole corpus estimates each
labeler's reliability and each pattern's probability; a logistic span classifier is then trained on these
probabilities, with features of the span besides the votes. Wide candidates that it accepts are added.

Votes and features take few values each, so the counted patterns are a small table at any corpus size.

Secrets (assigned tokens, keys and passwords with a digit among their first 64 characters, keys of known form, private-key headers) are found by rule alone; they are counted and
masked, but are no spans of the four kinds.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import map_arrow, write_table

KINDS = ("email", "ip", "card", "phone")
#: Least probability of an added span, characters of context, rounds of expectation-maximisation.
ACCEPT, CONTEXT, ROUNDS = 0.9, 32, 50

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+\Z|\A[A-Za-z0-9._%+-]*+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can begin inside a run of digits only after an earlier match, which takes its last run whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_PART, _DOT = "[A-Za-z0-9-]{1,63}", r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?"
_WIDE = {
    # a bracketed at, or a bare one before a domain with a written-out dot; "at site.com" alone is prose
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?: ?(?:\(at\)|\[at\]|\{{at\}}) ?{_PART}(?:(?:{_DOT}| ?\. ?){_PART}){{1,4}}| at {_PART}(?:\.{_PART}){{0,2}}{_DOT}{_PART}(?:(?:{_DOT}|\.){_PART}){{0,2}})", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9.])", re.I),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[._/ -][0-9]{4}){2}[._/ -][0-9]{1,7})(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:(?:\+|00)[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9.-])"),
}
_MARK = re.compile(r"[(\[{](?:at|dot)[)\]}]|\x20dot\x20", re.I)  # each written-out address has one

_HINTS = ("token", "secret", "passw", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")  # each secret has one
_SECRET = re.compile(
    r"""(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwd|password)["']?\s{0,4}[:=]\s{0,4}["']?(?P<a>(?=[A-Za-z+/_=-]{0,63}[0-9])[A-Za-z0-9+/_=-]{16,})"""
    r"""|\b(?P<b>(?-i:AKIA[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}))|(?P<c>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)""",
    re.I,
)

# fixed word lists of the labelers
_TLDS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "it", "nl", "ch", "at", "be", "pl", "se", "co", "me", "biz", "ai", "dev"}
_DIALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91"}
_FOR = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel|@"),
    "ip": re.compile(r"\bip\b|server|host|address|adresse|client|login|connect"),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|pay"),
    "phone": re.compile(r"tel|phone|fon|call|mobile|cell|fax|handy|anruf|movil|móvil|whatsapp"),
}
_AGAINST = re.compile(r"token|version|serial|sku|isbn|order|invoice|hash|sha|md5|uuid|build|\bv\.?$|#\s*$|[=\"'][0-9a-f]*$|\$\s*$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the four patterns, leftmost and non-overlapping by kind; failing matches are dropped."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done:  # the local part, a stretch at a time
            low = max(done, start - 256)
            start -= len(_LOCAL.search(text[low:start]).group())
            if start > low:
                break
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            found.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def secrets(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets in a text, leftmost first."""
    low = text.lower()
    return [m.span(m.lastgroup) for m in _SECRET.finditer(text)] if any(h in low for h in _HINTS) else []


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates of the wider patterns that touch no base span and none another."""
    found = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and not _MARK.search(text) or kind != "email" and not _DIGIT.search(text):
            continue
        found += [(k, m.start(), m.end()) for m in _WIDE[kind].finditer(text)]
    taken, kept, done = sorted((a, b) for _, a, b in base), [], 0
    starts = [a for a, _ in taken]
    ends = list(itertools.accumulate((b for _, b in taken), max))  # the last end of all spans up to each
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        before = bisect.bisect_left(starts, b)
        if a >= done and (not before or ends[before - 1] <= a):
            kept.append((k, a, b))
            done = b
    return kept


def votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """The labelers' votes, + for personal data, - against, 0 for none, and two features of the span."""
    name, span = KINDS[kind], text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    digits = digits_of(span)
    if name == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        check = "+" if tail.isalpha() else "-"
        gazetteer = "+" if tail in _TLDS else "-"
    elif name == "ip":
        parts = [int(p[-4:]) for p in re.findall("[0-9]+", span)]
        check = "+" if len(parts) == 4 and max(parts) <= 255 else "-"
        gazetteer = "-" if parts[0] in (0, 127, 255) or parts[0] < 3 and parts[1] == 0 else "+"
    elif name == "card":
        check = "+" if 13 <= len(digits) <= 19 and luhn(digits) else "-"
        gazetteer = "+" if digits[0] in "3456" else "-"
    else:
        check = "+" if 9 <= len(digits) <= 15 else "-"
        code = digits.removeprefix("00")
        known = any(code[:n] in _DIALLING for n in (1, 2)) if span[0] == "+" or digits.startswith("00") else digits[0] in "23456789"
        gazetteer = "+" if known else "-"
    context = "+" if _FOR[name].search(before) else "0"
    against = "-" if _AGAINST.search(before) else "0"
    edge = "i" if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else "o"
    return ("+" if base else "0") + check + gazetteer + context + against + edge + ("s" if " " in span else "n")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found, n_secrets) of every row: array of (kind, start, end, base, pattern), base spans first, and how many secrets there are."""
    kind = "array<struct<kind:int,start:int,end:int,base:boolean,pattern:string>>"
    fields = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())]))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hidden = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                wide = wide_spans(text or "", base)
                hidden.append(len(secrets(text or "")))
                out.append([{"kind": k, "start": a, "end": b, "base": is_base, "pattern": votes(text, k, a, b, is_base)} for some, is_base in ((base, True), (wide, False)) for k, a, b in some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, fields), pa.array(hidden, pa.int64())], names=["doc_id", "found", "n_secrets"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), propose, f"doc_id long, found {kind}, n_secrets long")


def expectation_maximisation(patterns: list[str], counts: np.ndarray, voters: int = 5, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pattern, reliability (voters, 2 classes, 3 votes)) of independent labelers, from a majority start."""
    v = np.array([["-0+".index(c) for c in p[:voters]] for p in patterns])
    p = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))
    rates = np.zeros((voters, 2, 3))
    for _ in range(rounds):
        prior = ((counts * p).sum() + 1) / (counts.sum() + 2)
        for j in range(voters):
            for cls, w in ((1, p), (0, 1 - p)):
                n = np.bincount(v[:, j], weights=counts * w, minlength=3) + 1
                rates[j, cls] = n / n.sum()
        log = np.log(rates)
        odds = np.log(prior / (1 - prior)) + sum(log[j, 1][v[:, j]] - log[j, 0][v[:, j]] for j in range(voters))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, rates


def features(patterns: list[str]) -> np.ndarray:
    """One column for each value of each place of a pattern, and a constant."""
    return np.array([[1.0] + [float(p[i] == c) for i, values in enumerate(("+0", "+-", "+-", "+0", "-0", "io", "sn")) for c in values] for p in patterns])


def train_classifier(patterns: list[str], counts: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    x, w = features(patterns), np.zeros(15)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (target - p)) - ridge * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def learn(found: DataFrame) -> dict[tuple[int, str], float]:
    """The classifier's probability of each (kind, pattern) that occurs; a kind has 128 patterns at most."""
    rows = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.pattern").count().collect()
    out: dict[tuple[int, str], float] = {}
    for kind in range(len(KINDS)):
        own = sorted((r["pattern"], r["count"]) for r in rows if r["kind"] == kind)
        if own:
            patterns, counts = [p for p, _ in own], np.array([float(n) for _, n in own])
            soft, _ = expectation_maximisation(patterns, counts)
            weights = train_classifier(patterns, counts, soft)
            out |= {(kind, p): float(v) for p, v in zip(patterns, 1 / (1 + np.exp(-features(patterns) @ weights)))}
    return out


def label(found: DataFrame, model: dict[tuple[int, str], float], accept: float = ACCEPT) -> DataFrame:
    """(doc_id, base, spans, n_secrets): arrays of (kind, start, end) sorted by kind and start; spans has base and added ones."""
    good = [f"{k}:{p}" for (k, p), v in sorted(model.items()) if v >= accept and p[1] == "+"]
    base = F.filter("found", lambda f: f["base"])
    kept = F.filter("found", lambda f: f["base"] | F.array_contains(F.array(*[F.lit(g) for g in good]).cast("array<string>"), F.concat_ws(":", f["kind"], f["pattern"])))

    def short(spans):
        return F.array_sort(F.transform(spans, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))))

    return found.select("doc_id", short(base).alias("base"), short(kept).alias("spans"), "n_secrets")


def as_text(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind (4: secret) in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{(*KINDS, 'secret')[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op1_pii(documents: DataFrame) -> DataFrame:
    """The contract's columns for every document, the numbers of added spans and of secrets, and all of them together with the base spans.

    n_email to n_phone are of base spans.
    """
    found = write_table(candidates(documents), "pii-candidates")
    spans = label(found, learn(found))

    def of_kind(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), "n_secrets", (F.size("spans") + F.col("n_secrets")).cast("long").alias("n_private"))


def redact(docs: DataFrame) -> DataFrame:
    """The pipeline's step: spans are masked in text, and n_chars follows. Null texts stay null.

    The classifier is learned from all rows in a first pass; the second finds and masks text by text, so no
    join brings texts and spans together.
    """
    model = learn(write_table(candidates(docs), "pii-candidates"))
    good = {key for key, v in model.items() if v >= ACCEPT and key[1][1] == "+"}

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = base + [s for s in wide_spans(text or "", base) if (s[0], votes(text, *s, False)) in good]
                spans += [(4, a, b) for a, b in secrets(text or "")]
                out.append(redact_text(text, spans) if spans else text)
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "text", pa.array(out, pa.string()))

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return map_arrow(rows, mask, rows.schema).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
