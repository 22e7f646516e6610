"""Personal data in texts: patterns propose spans, checks confirm them, words near by adjust a score.

Offsets are code points, the end exclusive. Spans of one kind never overlap; a match that fails its check is dropped and not
tried again. Every confirmed span is returned; ``score`` tells how sure it is, and callers choose their own threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.session import ship_package

# The patterns, limits and order of the base kinds. An address can only begin where its digits do (what comes
# before is no digit) and takes whole runs of digits; saying so keeps the search linear in long runs of digits.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
BASE = ("email", "ip", "card", "phone")
# Added kinds, in capitals: an account number of a bank with its country's letters and check digits.
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# What programs call their secrets, then the value; national numbers of Spain and France with their check characters.
SECRET = re.compile(r"""(?i:(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|token|secret|passwd|password)["']?[\x20\t]*[=:][\x20\t]*["']?)([A-Za-z0-9+/=_.~-]{16,})""")
DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}[A-Z](?![A-Za-z0-9])")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIR = re.compile(r"(?<![A-Za-z0-9])[12][0-9]{2}(?:0[1-9]|1[0-2])[0-9]{10}(?![A-Za-z0-9])")
KINDS = (*BASE, "iban", "secret", "dni", "nir")

LEAST_BITS = 3.0  # entropy of a secret's characters; words and repeated characters have less

NEAR = 40  # code points on each side in which a context word counts
HINTS = {
    "email": "mail e-mail email contact write correo courriel kontakt",
    "ip": "ip address server host network adresse",
    "card": "card credit visa mastercard payment karte tarjeta carte",
    "phone": "phone call tel mobile fax telefon téléphone teléfono",
    "iban": "iban account bank konto cuenta compte",
    "secret": "key token secret password passwd api auth bearer credentials",
    "dni": "dni nif identidad documento",
    "nir": "nir sécu sécurité sociale social insee",
}
AGAINST = "order invoice version serial isbn article item"
START = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "secret": 0.8, "dni": 0.5, "nir": 0.6}
MAILBOX_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TEN = "0123456789"


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, cross-added: a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """First four characters moved to the end, letters as 10 to 35: rest 1 of 97."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values given to names of secrets that look drawn at random: letters and digits, and enough entropy."""
    for found in SECRET.finditer(text):
        value = found[1]
        if any(c in _TEN for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_BITS:
            yield found.span(1)


def dni(code: str) -> bool:
    return code[8] == DNI_LETTERS[int(code[:8]) % 23]


def nir(code: str) -> bool:
    return int(code[13:]) == 97 - int(code[:13]) % 97


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of mailbox and domain, leftmost first, found from the rare @ rather than from every letter."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in MAILBOX_CHARS:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _numbers(text: str) -> str:
    return "".join(c for c in text if c in _TEN)


def _ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in text.split("."))


def _card(text: str) -> bool:
    digits = _numbers(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 9 <= len(_numbers(text)) <= 15


def _checked(pattern: re.Pattern, holds: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if holds(m.group()))


#: The whole mechanism: kind, and what finds its confirmed spans.
FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": emails, "ip": _checked(IP, _ip), "card": _checked(CARD, _card), "phone": _checked(PHONE, _phone), "iban": _checked(IBAN, mod97),
    "secret": secrets, "dni": _checked(DNI, dni), "nir": _checked(NIR, nir),
}


@dataclass
class Context:
    """Words near a span that make it likelier (of its kind) or less likely."""

    near: int = NEAR
    hints: dict[str, frozenset[str]] = field(default_factory=lambda: {k: frozenset(v.split()) for k, v in HINTS.items()})
    against: frozenset[str] = frozenset(AGAINST.split())

    def score(self, text: str, kind: str, start: int, end: int) -> float:
        around = {*re.findall(r"[\w-]+", (text[max(0, start - self.near) : start] + " " + text[end : end + self.near]).lower())}
        return min(1.0, max(0.0, START[kind] + 0.2 * bool(around & self.hints[kind]) - 0.3 * bool(around & self.against)))


def spans(text: str, context: Context) -> list[tuple[str, int, int, float]]:
    """All confirmed spans: kind, start, end, score; by start, then kind as listed."""
    found = [(start, i, end, kind) for i, kind in enumerate(KINDS) for start, end in FINDERS[kind](text)]
    return [(kind, start, end, context.score(text, kind, start, end)) for start, _, end, kind in sorted(found)]


SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
])


def find_personal_data(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of every whole text as an array of structs ``out`` (replaced if it exists); null and empty texts have none."""
    ship_package(df.sparkSession)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = [f.name for f in SPAN]

    def run(batches):
        context = Context()
        for batch in batches:
            made = [[dict(zip(names, s)) for s in spans(t or "", context)] for t in batch.column(text).to_pylist()]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != out]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(made, arrow)], [*(n for n, _ in rest), out])

    fields = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(SPAN))]))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", least: float = 0.5) -> DataFrame:
    """Replace spans scored ``least`` or more in ``text`` by their kind in brackets; overlapping spans become the first one."""
    chosen = F.filter(spans, lambda s: s["score"] >= least)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("done"), s["end"].alias("at")))
    end = lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.char_length(text)))
    return df.withColumn(text, F.aggregate(chosen, start, step, end))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


SURE = 0.5  # score from which ``report`` counts a span as personal data


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, a count of each added kind, ``n_sure`` (spans of any kind
    scored ``SURE`` or more) and ``top_score`` (null without spans) of every row.

    Null and empty texts have no spans; long texts are searched whole; repeated rows are reported each, rows without ``doc_id`` too.
    An empty table gives no rows; other columns are not read.
    """
    found = find_personal_data(docs.select("doc_id", "text"), out="found").select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    scores = F.transform("found", lambda s: s["score"])
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
        F.size(F.filter(scores, lambda x: x >= SURE)).cast("long").alias("n_sure"), F.array_max(scores).alias("top_score"),
    )
