"""Personal data by weak supervision.

Four base patterns always report their spans.  Wider patterns propose further
candidates, and labelers vote on every candidate: its pattern's own check, a
gazetteer, the words before it, the words after it, its edges and its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is without any labels, and a logistic span classifier learns those
probabilities from features of the span.  Candidates that it accepts are reported
beside the base spans.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.tables import written

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("hidden_email", "local_phone", "national_id", "bank_account", "birth_date", "person", "secret")
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ("check", "gazetteer", "before", "after", "edges", "shape")
ROUNDS = 50
ACCEPT = 0.9
CONTEXT = 48  # code points on either side that a labeler sees

# The base patterns.  Possessive or anchored forms of the same languages keep the scans linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider candidate patterns.
_WIDER = {
    "hidden_email": re.compile(
        r"(?<![\w.])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,63}+"
        r" ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b"
    ),
    "local_phone": re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "bank_account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "birth_date": re.compile(r"(?<![\w./-])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}(?![\w/-])"),
    "person": re.compile(
        r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.? [A-Z][\w'-]+(?: [A-Z][\w'-]+)?"
    ),
    "secret": re.compile(
        r"(?:(?i:password|passwd|pwd|token|secret|api[_-]?key)[ ]?[=:][ ]?[\"']?[^\s\"']{6,}+[\"']?)"
        r"|(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
    ),
}
# A text without any of these strings has no match; None: a digit is the clue.
_CLUES = {
    "hidden_email": ("dot",),
    "local_phone": None,
    "national_id": None,
    "bank_account": None,
    "birth_date": None,
    "person": ("Mr", "Ms", "Mme", "Mon", "Mad", "Dr", "Prof", "Herr", "Frau", "Sr", "Señor"),
    "secret": ("=", ":", "AKIA"),
}

# Gazetteers.
_PROVIDERS = ("gmail", "yahoo", "hotmail", "outlook", "icloud", "proton", "gmx", "web", "mail", "aol")
_DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co")
_NAMES = (
    "James John Robert Michael David William Mary Patricia Jennifer Linda Elizabeth Susan Anna Maria Peter Paul Thomas "
    "Hans Klaus Jürgen Ursula Pierre Jean Marie Claire Luc José Carlos Juan Carmen Lucía Ana Miguel"
).split()
_COUNTRIES = "AT BE CH CY CZ DE DK ES FI FR GB GR IE IT LU MT NL NO PL PT SE".split()
_CUES = {
    "email": "mail contact write reply kontakt correo courriel",
    "hidden_email": "mail contact write reply kontakt correo courriel",
    "ip": "ip address host server login adresse dirección",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call fax mobile telefon téléphone teléfono",
    "local_phone": "phone tel call fax mobile telefon téléphone teléfono",
    "national_id": "ssn social security id tax",
    "bank_account": "iban account bank konto compte cuenta",
    "birth_date": "born birth dob geboren né née nacido nacida",
    "person": "name contact dear signed by von de",
    "secret": "password passwd pwd token secret key login",
}
_AGAINST = re.compile(r"(?:version|v\.|release|isbn|fig\.?|figure|section|page|chapter|order|invoice|§|no\.)\s*\Z", re.I)
_CUE_PATTERNS = {k: re.compile(rf"(?<!\w)(?:{'|'.join(v.split())})", re.I) for k, v in _CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping addresses: each @ with the longest local part that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _is_local(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _is_local(c: str) -> bool:
    return c in "._%+-" or (c < "\x7f" and c.isalnum())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns in code points, by kind, then start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def wider_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the wider patterns that touch none of ``taken``; a secret that does gives its parts outside of them."""
    found, has_digit = [], bool(_DIGIT.search(text))
    for kind, pattern in _WIDER.items():
        clues = _CLUES[kind]
        if has_digit if clues is None else any(c in text for c in clues):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if taken and found:
        order = sorted((a, b) for _, a, b in taken)
        starts, reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))
        free = lambda a, b: not (i := bisect_left(starts, b)) or reach[i - 1] <= a
        touching = [s for s in found if s[0] == "secret" and not free(s[1], s[2])]
        found = [s for s in found if free(s[1], s[2])]
        for _, start, end in touching:
            i, parts = bisect_right(reach, start), []
            while i < len(order) and order[i][0] < end:
                parts, start, i = [*parts, (start, order[i][0])], max(start, order[i][1]), i + 1
            parts = [p for p in [*parts, (start, end)] if p[1] - p[0] >= 6]
            # what precedes the first base span must be a secret by itself
            if parts and _WIDER["secret"].match(text, *parts[0]):
                found += [("secret", *p) for p in parts]
    return found


def _check(kind: str, span: str) -> int:
    digits = _digits(span)
    if kind == "ip":
        return 1 if not span.startswith(("0.", "255.")) else -1
    if kind == "card":
        return 1 if digits[0] in "23456" else -1
    if kind in ("phone", "local_phone"):
        return 1 if 10 <= len(digits) <= 13 else -1
    if kind == "national_id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    if kind == "bank_account":
        plain = span.replace(" ", "")
        moved = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(moved) % 97 == 1 else -1
    if kind == "birth_date":
        parts = [int(p) for p in re.split(r"[./-]", span)]
        year, day, month = (parts[0], parts[2], parts[1]) if parts[0] > 31 else (parts[2], parts[0], parts[1])
        return 1 if 1 <= month <= 12 and 1 <= day <= 31 and (year < 100 or 1900 <= year <= 2025) else -1
    if kind == "secret":
        value = re.split(r"[=:]", span)[-1].strip(" \"'")
        return 1 if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else -1
    return 1


def _gazetteer(kind: str, span: str) -> int:
    low = span.lower()
    if kind in ("email", "hidden_email"):
        return 1 if low.rsplit(".", 1)[-1] in _DOMAIN_ENDS or any(p in low for p in _PROVIDERS) else 0
    if kind == "ip":
        return -1 if low.startswith(("127.", "0.", "255.")) else 0
    if kind == "phone":
        return 1 if re.match(r"\+(?:1|33|34|44|49|39|31|32|41|43|46)(?!\d{12})", low) else 0
    if kind == "bank_account":
        return 1 if span[:2] in _COUNTRIES else -1
    if kind == "person":
        return 1 if any(n in span.split() for n in _NAMES) else 0
    if kind == "secret":
        return 1 if span.startswith("AKIA") else 0
    return 0


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """The vote of each labeler on a span: 1 personal, -1 not, 0 abstains."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    cue = _CUE_PATTERNS[kind]
    edges = (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum())
    distinct = len(set(span.lower()) - set(" .-()+"))
    return (
        _check(kind, span),
        _gazetteer(kind, span),
        -1 if _AGAINST.search(before) else 1 if cue.search(before) or (kind == "secret" and cue.search(span)) else 0,
        1 if cue.search(after) else 0,
        1 if edges else -1,
        1 if distinct >= 4 else -1,
    )


def span_features(given: tuple[int, ...], text: str, start: int, end: int) -> int:
    """Bits that the final classifier sees beside the kind: the span, its edges and its check and cues."""
    span = text[start:end]
    digits = sum("0" <= c <= "9" for c in span)
    bits = (
        digits * 2 >= len(span),
        digits >= 8,
        any(c.isupper() for c in span),
        any(c.islower() for c in span),
        " " in span,
        any(c in span for c in "@=:"),
        len(span) >= 16,
        start == 0 or text[start - 1].isspace(),
        end == len(text) or text[end].isspace() or text[end] in ".,;:!?",
        "\n" in text[max(0, start - 2) : start] or start == 0,
        given[0] > 0,
        given[2] > 0,
        given[2] < 0,
    )
    return sum(1 << i for i, bit in enumerate(bits) if bit)


N_FEATURES = 13
_FOUND = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("is_base", T.BooleanType()),
        T.StructField("votes", T.IntegerType()),
        T.StructField("features", T.IntegerType()),
    ]
)
_CANDIDATES = T.StructType(
    [
        T.StructField("base", T.StringType()),
        T.StructField("n", T.ArrayType(T.LongType())),
        T.StructField("found", T.ArrayType(_FOUND)),
    ]
)


def _pattern(given: tuple[int, ...]) -> int:
    """Votes as one number, in base 3."""
    return sum((v + 1) * 3**i for i, v in enumerate(given))


@F.pandas_udf(_CANDIDATES)
def _candidates(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base = base_spans(text)
        found = []
        for spans, is_base in ((base, True), (wider_spans(text, base), False)):
            for kind, a, b in spans:
                given = votes(kind, text, a, b)
                found.append((KINDS.index(kind), a, b, is_base, _pattern(given), span_features(given, text, a, b)))
        n = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
        rows.append((",".join(f"{k}:{a}:{b}" for k, a, b in base), n, found))
    return pd.DataFrame(rows, columns=["base", "n", "found"])


def candidates(text: str = "text") -> Column:
    """Struct (base, n, found) of a text column: its base spans as text and all candidates with their votes."""
    return _candidates(F.coalesce(F.col(text), F.lit("")))


def labeler_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
    """Expectation-maximisation over distinct vote patterns.

    ``patterns`` has a row per pattern with a column per labeler (-1, 0, 1).  Two
    hidden classes; labelers vote independently given the class.  The start is the
    majority vote, smoothing keeps every probability positive.  Returns the
    probability of "personal" per pattern, P(vote | class) per labeler, and the prior.
    """
    lean = patterns.sum(axis=1)
    p = 1 / (1 + np.exp(-lean.astype(float)))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        vote = np.einsum("cn,nlv->clv", weight, onehot)
        # agreement with the majority is the weak belief that the smoothing carries
        belief = np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]])[:, None, :]
        vote = (vote + belief) / (vote.sum(axis=2, keepdims=True) + belief.sum(axis=2, keepdims=True))
        log = np.log(prior)[:, None] + np.einsum("nlv,clv->cn", onehot, np.log(vote))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    return p, vote, prior


def _design(kinds: np.ndarray, features: np.ndarray) -> np.ndarray:
    bits = (features[:, None] >> np.arange(N_FEATURES)) & 1
    return np.hstack([np.ones((len(kinds), 1)), np.eye(len(KINDS))[kinds], bits]).astype(float)


def fit_span_classifier(kinds, features, probability, counts, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model of ``probability``, by Newton steps over weighted distinct rows."""
    x, w = _design(kinds, features), np.zeros(1 + len(KINDS) + N_FEATURES)
    share = counts / counts.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (probability - p)) - ridge * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class SpanModel:
    """Accepts a candidate whose learnt probability is at least ACCEPT."""

    weights: tuple[float, ...]
    reliabilities: tuple

    def probability(self, kind: Column, features: Column) -> Column:
        kinds = F.array(*[F.lit(w) for w in self.weights[1 : 1 + len(KINDS)]])
        z = F.lit(self.weights[0]) + F.get(kinds, kind)
        for i, weight in enumerate(self.weights[1 + len(KINDS) :]):
            z = z + F.lit(weight) * features.bitwiseAND(F.lit(1 << i)).cast("boolean").cast("double")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def learn(found: DataFrame) -> SpanModel:
    """A model from every candidate of the column ``found`` of a written table.

    Candidates are counted per (kind, votes, features) before they leave the
    executors; there are at most 11 * 3^6 * 2^13 such rows whatever the corpus, and
    far fewer occur.  Without candidates nothing is accepted.
    """
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features")
    counted = each.agg(F.count(F.lit(1)).alias("n")).toPandas()
    if counted.empty:
        return SpanModel((-30.0,) + (0.0,) * (len(KINDS) + N_FEATURES), ())
    counted = counted.sort_values(["kind", "votes", "features"])
    kinds, pattern, features, n = (counted[c].to_numpy(np.int64) for c in ("kind", "votes", "features", "n"))
    given = pattern[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
    p, vote, _ = labeler_reliabilities(given, n.astype(float))
    weights = fit_span_classifier(kinds, features, p, n.astype(float))
    return SpanModel(tuple(map(float, weights)), tuple(map(tuple, vote[1].round(6).tolist())))


def accepted(found: DataFrame, model: SpanModel) -> DataFrame:
    """``found`` with ``spans``: its base spans and the accepted candidates, by kind, then start."""
    keep = F.filter(
        "found", lambda c: c["is_base"] | (model.probability(c["kind"], c["features"]) >= F.lit(ACCEPT))
    )
    spans = F.array_sort(F.transform(keep, lambda c: F.struct(c["kind"], c["start"], c["end"])))
    return found.withColumn("spans", spans)


def as_text(spans: str = "spans") -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(one, ",")


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        parts, at = [], 0
        for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:  # of overlapping spans the first and longest names the mark
                parts += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]) if parts else text)
    return pd.Series(out)


def masked(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; texts without spans stay as they are."""
    return F.when(F.size(spans) > 0, _masked(F.col(text), F.col(spans))).otherwise(F.col(text))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, n, spans) for every row of ``docs`` (doc_id, text).

    A null or empty text has no spans; repeated rows get equal results; a null id is
    carried through.  The texts are read once.
    """
    found = written(docs.select("doc_id", candidates().alias("c")).select("doc_id", "c.*"))
    return accepted(found, learn(found)).select("doc_id", "base", "n", "spans")
