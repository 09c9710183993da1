"""Personal data by weak supervision.

Patterns find candidate spans, and so do the word lists (a listed given name and the words
with a capital after it) and context (such words, or digits, after a cue like ``Dear`` or
``tel``). Patterns, word lists and context then give each span a vote for, against or none.
Spark counts how often each combination of votes occurs; from those counts (a table whose
size is fixed by the number of labelers, kinds and bins) expectation-maximisation on the
driver estimates how reliable each labeler is for each kind, starting from the belief that
a vote is more often right than wrong, which ``BELIEF`` spans of a kind would outweigh. A
logistic span classifier, with weights of its own for each kind's votes, is trained on the
resulting soft labels. Spans of the four base kinds that pass their checks always stay; the
classifier decides on all other candidates, span by span.

Positions are code points, ends exclusive. Defined results: a null or empty text has no
span; spans of one kind don't overlap; repeated rows each have their spans; without any
candidate in the corpus the classifier accepts none; other columns pass through
``redact`` unchanged.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.tables import texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_spelled", "phone_local", "secret", "person")
LABELERS = 6
#: Spans that the first belief in a labeler counts as, and how often it takes a vote to be right.
BELIEF, RIGHT = 8.0, 0.75
LENGTH_EDGES, DIGIT_EDGES = (8, 16, 24, 40), (0.01, 0.3, 0.8)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a number that starts inside a run of digits fails as the whole run does, so only run starts are tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z]{2,16}")
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"[A-Za-z0-9+/_-]{24,}+={0,2}")
PERSON = re.compile(r"[MDHFS](?:r|rs|s|me|lle|err|rau|eñora?)\.? [A-ZÀ-Ý][\w'-]+(?: [A-ZÀ-Ý][\w'-]+)?")
CAPITALISED = re.compile(r"\b[A-ZÀ-ÖØ-Þ](?:['’-]?[A-Za-zÀ-ÖØ-öø-ÿ])+")
#: A number with a trunk prefix, and digits that only a cue before them makes a phone number.
TRUNK_PHONE = re.compile(r"(?<![0-9+.-])\(?0[1-9][0-9]{0,3}\)?[ /-][0-9](?:[ /-]?[0-9]){4,9}(?![0-9])")
CUED_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9](?:[ ()/-]{0,2}[0-9]){5,13}(?![\w-])")
WORDS_BEFORE = re.compile(r"\w+")
LAST_WORD = re.compile(r"\w+$")
#: Words of a name without a title, and characters before a span in which its cue stands.
NAME_WORDS, CUE_REACH = 3, 24

# fixed word lists of the gazetteer and context labelers
TOP_DOMAINS = frozenset("com org net edu gov io de fr es it nl eu uk us info biz example test".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "65", "81", "82", "86", "90", "91")
CUES = {
    "email": frozenset("email mail e contact correo courriel adresse write reach ask mailto schreiben escribir".split()),
    "ip": frozenset("ip host address server login from client adresse dirección serveur gateway".split()),
    "card": frozenset("card visa credit debit payment carte karte tarjeta account konto compte cuenta mastercard amex".split()),
    "phone": frozenset("phone tel call mobile fax telefon telephone cell number téléphone teléfono handy portable numéro número nummer".split()),
    "secret": frozenset("token key secret password passwd pwd api auth bearer credential apikey passwort contraseña clave schlüssel jeton".split()),
    "person": frozenset("dear by signed contact regards name patient from client cher chère liebe lieber estimado estimada sincerely doctor author".split()),
}
#: Cues after which one word with a capital may be a name; after the others it takes two.
GREETINGS = frozenset("dear signed regards sincerely cher chère liebe lieber estimado estimada".split())
#: Words with a capital that stand where names do.
NOT_NAMES = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag lundi mardi mercredi jeudi vendredi lunes martes "
    "the this that these all any our your his her their its sir madam reader readers team customer customers friend friends colleague colleagues user users new north south east west san saint st mount lake river street city university "
    "company department office bank group page version copyright system data server table figure damen herren kunde kunden kollegen freunde madame monsieur client clients amis señor señora señores amigos clientes".split()
)
AGAINST = frozenset("version v page chapter section isbn issn build figure table sha commit checksum digest hash seite kapitel chapitre capítulo tabelle tableau figura".split())
GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew sandra anthony emily mark emma "
    "steven olivia paul sophia andrew hannah joshua grace kevin alice brian julia george laura edward anna peter maria hans klaus sabine petra jürgen wolfgang heike stefan uwe monika ursula karl fritz greta lukas "
    "jonas leon lena katharina pierre marie jean luc claire camille nicolas julien sophie antoine louis chloé manon philippe françois isabelle carlos jose josé lucia lucía juan miguel carmen javier ana pablo diego "
    "sofia sofía manuel pilar rosa elena fernando luis jorge raquel wei ming yuki hiroshi fatima omar ahmed amina priya raj ivan olga natasha dmitri".split()
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from their @ signs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_and_misses(text: str) -> list[tuple[str, int, int, bool]]:
    """All matches of the base patterns as (kind, start, end, whether it passes its check)."""
    found = [("email", a, b, True) for a, b in _emails(text)]
    for m in IP.finditer(text):
        found.append(("ip", m.start(), m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if len(digits) >= 13:
                found.append(("card", m.start(), m.end(), len(digits) <= 19 and _luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            found.append(("phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return found


def _cue(text: str, start: int) -> str:
    """The word before ``start``, in small letters, where only blanks, commas, colons and dots of short forms stand between."""
    head = text[max(0, start - CUE_REACH) : start]
    stem = head.rstrip(" ,:.\n\t(")
    if not 0 < len(head) - len(stem) <= 3:
        return ""
    found = LAST_WORD.search(stem)
    return found.group().lower() if found else ""


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Names by list and context: up to three words with capitals in a row, from a listed given name on or after a cue.

    After a weak cue, like ``by``, a single word that no list knows is none, nor is what
    begins with a word that no name begins with.
    """
    start, end, words, alone = 0, 0, 0, False
    for m in CAPITALISED.finditer(text):
        if 0 < words < NAME_WORDS and m.start() == end + 1 and text[end] == " ":
            end, words = m.end(), words + 1
            continue
        if words > 1 or words and alone:
            yield start, end
        start, end, words = *m.span(), 1
        alone = m.group().lower() in GIVEN_NAMES
        if not alone:
            cue = _cue(text, start)
            # the sentence may have ended before the word
            cued = cue in CUES["person"] and "." not in text[max(0, start - 2) : start]
            alone, words = cued and cue in GREETINGS, int(cued and m.group().lower() not in CUES["person"] | NOT_NAMES)
    if words > 1 or words and alone:
        yield start, end


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    """Phone numbers without a country's code: in groups of 3, 3 and 4, with a trunk prefix, or any after a cue."""
    for m in LOCAL_PHONE.finditer(text):
        if m.start() == 0 or not (text[m.start() - 1].isdigit() or text[m.start() - 1] in "+-"):
            yield m.span()
    for m in TRUNK_PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 12:
            yield m.span()
    for m in CUED_PHONE.finditer(text):
        if _cue(text, m.start()) in CUES["phone"]:
            yield m.span()


def _apart(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans from the left, of those with one start the longest, without any that reaches into the last."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover."""
    starts, ends = [], []
    for a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start; other kinds leave out what a base span covers."""
    found = base_and_misses(text)
    taken = sorted((a, b) for _, a, b, ok in found if ok)
    more = []
    if " dot " in text or "(dot)" in text or "[dot]" in text:
        more += [("email_spelled", *m.span(), False) for m in SPELLED.finditer(text)]
    more += [("phone_local", a, b, False) for a, b in _apart(_local_phones(text))]
    more += [("secret", *m.span(), False) for m in SECRET.finditer(text) if any("0" <= c <= "9" for c in m.group()) and any(c.isalpha() for c in m.group())]
    titled = [m.span() for m in PERSON.finditer(text) if m.start() == 0 or not text[m.start() - 1].isalnum()]
    more += [("person", a, b, False) for a, b in _apart([*titled, *_names(text)])]
    if taken and more:
        starts, ends = _merged(taken)
        # of the merged base spans, the last one that begins before the span's end is the one that may reach into it
        more = [x for x in more if (k := bisect_right(starts, x[2] - 1)) == 0 or ends[k - 1] <= x[1]]
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(found + more, key=lambda x: (order[x[0]], x[1], x[2]))


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One character a labeler: + for, - against, 0 no vote."""
    span = text[start:end]
    general = {"email_spelled": "email", "phone_local": "phone"}.get(kind, kind)
    digits = _digits(span)
    titled = kind == "person" and PERSON.match(span)
    got = ["+" if base or titled or kind == "phone_local" and LOCAL_PHONE.fullmatch(span) else "-" if kind in BASE_KINDS else "0"]
    # shape
    if general == "email":
        shaped = span[-2:].isalpha() and ".." not in span
    elif kind == "ip":
        shaped = not span.startswith("0") and len(span) >= 9
    elif kind == "card":
        shaped = digits[:1] in "3456" and len(set(digits)) > 3
    elif general == "phone":
        # a subscriber's number alone has 7 or 8 digits in groups
        grouped = len(digits) in (7, 8) and not span.isdigit()
        shaped = span.count("(") == span.count(")") and (grouped or len(digits) >= (8 if digits[0] == "0" else 10))
    elif kind == "secret":
        shaped = len(span) in (32, 40, 64) or (any(c.isupper() for c in span) and any(c.islower() for c in span))
    elif titled:
        shaped = "." in span
    else:  # two words or more, none of capitals only
        shaped = " " in span and not any(w.isupper() for w in span.split())
    got.append("+" if shaped else "-")
    # word lists
    if general == "email":
        listed = "+" if span.replace("]", " ").replace(")", " ").replace(".", " ").split()[-1].lower() in TOP_DOMAINS else "-"
    elif kind == "ip":
        listed = "-" if span.startswith(("10.", "127.", "192.168.", "0.")) else "+"
    elif kind == "phone":
        listed = "+" if digits.startswith(COUNTRY_CODES) else "-"
    elif kind == "phone_local":  # a trunk prefix, or an area and exchange that begin with 2 to 9
        listed = "+" if digits[0] == "0" or len(digits) == 10 and min(digits[0], digits[3]) >= "2" else "-" if len(digits) == 10 else "0"
    elif kind == "person":
        words = [w.lower() for w in span.split()[1 if titled else 0 :]]
        listed = "+" if any(w in GIVEN_NAMES for w in words) else "-" if any(w in NOT_NAMES for w in words) else "0"
    else:
        listed = "0"
    got.append(listed)
    # context
    before = [w.lower() for w in WORDS_BEFORE.findall(text[max(0, start - 40) : start])[-4:]]
    cued = any(w in CUES[general] for w in before)
    got.append("+" if cued else "-" if any(w in AGAINST for w in before) else "0")
    # variety of characters
    variety = len(set(span)) / len(span)
    got.append("+" if variety > 0.3 else "-" if variety < 0.15 else "0")
    # what stands next to it
    left, right = text[start - 1 : start], text[end : end + 1]
    got.append("-" if left.isalnum() or right.isalnum() or left in ("/", "_", "#") and left or right in ("/", "_") and right else "+")
    return "".join(got)


def feature_key(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """All the classifier sees of a span: kind, votes, and bins of length and share of digits."""
    length = end - start
    share = len(_digits(text[start:end])) / length
    return f"{kind} {votes(text, kind, start, end, base)} {sum(length >= x for x in LENGTH_EDGES)}{sum(share >= x for x in DIGIT_EDGES)}"


def _features(key: str) -> np.ndarray:
    """Which votes and bins a span shows, after a constant."""
    _, vote, bins = key.split(" ")
    x = np.zeros(1 + 2 * LABELERS + len(LENGTH_EDGES) + len(DIGIT_EDGES) + 2)
    x[0] = 1
    for k, v in enumerate(vote):
        if v != "0":
            x[1 + 2 * k + (v == "-")] = 1
    at = 1 + 2 * LABELERS
    x[at + int(bins[0])] = 1
    x[at + len(LENGTH_EDGES) + 1 + int(bins[1])] = 1
    return x


def _vector(key: str) -> np.ndarray:
    """The features once for all kinds and once for the span's own."""
    x = _features(key)
    out = np.zeros((1 + len(KINDS), len(x)))
    out[0] = out[1 + KINDS.index(key.split(" ")[0])] = x
    return out.reshape(-1)


@dataclass(frozen=True)
class SpanModel:
    weights: tuple[float, ...]
    #: by kind: P(vote + / - / 0) of each labeler, for spans that are not personal data and that are
    reliability: dict[str, tuple]

    def probability(self, key: str) -> float:
        if not self.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(self.weights, _vector(key)))))))


def vote_counts(docs: DataFrame) -> DataFrame:
    """(key, n): how many candidate spans of the corpus show each combination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in texts(batch.column(0)):
                for c in candidates(text):
                    key = feature_key(text, *c)
                    total[key] = total.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rounds: int = 50) -> SpanModel:
    """Estimate the labelers' reliabilities by EM and train the span classifier."""
    rows = sorted((r["key"], r["n"]) for r in vote_counts(docs).collect())  # bounded by kinds, votes and bins
    if not rows:
        return SpanModel((), {})
    keys, n = [k for k, _ in rows], np.array([c for _, c in rows], float)
    vote = np.array([["+-0".index(v) for v in k.split(" ")[1]] for k in keys])
    kind = np.array([KINDS.index(k.split(" ")[0]) for k in keys])
    for_, against = (vote == 0).sum(1), (vote == 1).sum(1)
    p = (for_ + 0.5) / (for_ + against + 1)  # the first guess is the majority of the votes
    log, tables = np.zeros((2, len(keys))), {}
    for k in sorted(set(kind.tolist())):
        mine = kind == k
        tables[KINDS[k]], log[:, mine] = _reliabilities(vote[mine], n[mine], p[mine], rounds)
    p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    x = np.stack([_vector(k) for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression on the soft labels
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - q)) - w)
        w += np.clip(step, -2, 2)
    return SpanModel(tuple(w.tolist()), tables)


def _reliabilities(vote: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int) -> tuple[tuple, np.ndarray]:
    """EM over the vote combinations of one kind: P(vote) by class and labeler, and ln P(combination and class)."""
    belief = np.array([[1 - RIGHT, RIGHT], [RIGHT, 1 - RIGHT]])  # by class: + and - among the votes that are given
    table, log = np.zeros((2, LABELERS, 3)), np.zeros((2, len(n)))
    p = np.clip(p, 0.02, 0.98)
    for _ in range(rounds):
        prior = ((p * n).sum() + 1) / (n.sum() + 2)
        for c, w in ((0, (1 - p) * n), (1, p * n)):
            for lab in range(LABELERS):
                got = np.bincount(vote[:, lab], w, 3)
                silent = (n[vote[:, lab] == 2].sum() + 1) / (n.sum() + 3)  # silence says nothing at first
                got += BELIEF * np.array([*(belief[c] * (1 - silent)), silent])
                table[c, lab] = got / got.sum()
        log = np.stack([np.log(share) + sum(np.log(table[c, lab, vote[:, lab]]) for lab in range(LABELERS)) for c, share in ((0, 1 - prior), (1, prior))])
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return tuple(tuple(tuple(v) for v in c) for c in table.tolist()), log


def accepted(text: str, model: SpanModel, known: dict[str, float], threshold: float) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, probability, base) of the spans that stay, by kind as listed, then start."""
    out = []
    for c in candidates(text):
        key = feature_key(text, *c)
        if key not in known:
            known[key] = model.probability(key)
        if c[3] or c[0] not in BASE_KINDS and known[key] >= threshold:
            out.append((c[0], c[1], c[2], known[key], c[3]))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,probability:double,base:boolean>>"


def find_spans(docs: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """doc_id and the spans of each document."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        names = ("kind", "start", "end", "probability", "base")
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in accepted(x, model, known, threshold)] for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, and ``n_chars`` counted anew.

    Of spans that overlap, the first by start (then the longest) names the replacement, and
    it covers them all. A null text stays null.
    """

    @F.pandas_udf("string")
    def clean(column):
        known: dict[str, float] = {}

        def one(text):
            if not text:
                return text
            parts, at, name = [], 0, None
            for kind, start, end, _, _ in sorted(accepted(text, model, known, threshold), key=lambda s: (s[1], -s[2])):
                if name is None or start >= at:
                    parts += [text[at:start], f"[{kind.upper()}]"]
                    name = kind
                at = max(at, end)
            return "".join([*parts, text[at:]])

        return column.map(one, na_action="ignore")

    text = clean(F.col("text"))
    columns = [text.alias("text") if c == "text" else c for c in docs.columns if c != "n_chars"]
    out = docs.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
