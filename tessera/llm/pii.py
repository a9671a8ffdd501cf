"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns' spans always stay. The field looks at the stretches of a text that
hold digits or address signs, scores every candidate segment there by features
of the whole span (its digits, groups and separators, check sum, surroundings and
the cue words before it), and chooses boundaries and kinds together by dynamic
programming over segments of bounded length. It is trained here, by maximum
likelihood, on stretches that the patterns label and on rewritten ones (numbers
without a plus sign, spelled-out addresses), and adds what it is sure of.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents with candidates from which the field is trained and stretches of them, in expectation; passes over them; step; strength of the prior.
TRAIN_DOCS, TRAIN_STRETCHES, PASSES, STEP, PRIOR = 600, 12_000, 6, 0.3, 1e-3
#: Tokens in a segment at most (no entity of the four kinds is longer), and the probability from which a span is added.
LONGEST, SURE = 32, 0.9
#: Characters before a segment that are searched for cue words.
BEFORE = 24

# A match begins where its run of digits does, as a match takes the last run whole; so each run is tried once.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_HOT = re.compile(r"[0-9@]+|[\[(](?:at|AT)[\])]| at (?=[A-Za-z0-9-]+ dot )")
# Spelled-out signs stand alone or in brackets, so that no character can be read both as a part of a word and of a sign.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?: ?[\[(](?:at|AT)[\])] ?| at )[A-Za-z0-9-]+(?:(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?| dot )[A-Za-z0-9-]+)+")
_CUES = {
    "email": re.compile(r"(?i)(e-?mail|mail|contact|correo|courriel)\W*\Z"),
    "ip": re.compile(r"(?i)(ip|host|server|address|adresse)\W*\Z"),
    "card": re.compile(r"(?i)(card|visa|mastercard|credit|karte|carte|tarjeta)\W*(number|no|nr)?\W*\Z"),
    "phone": re.compile(r"(?i)(phone|tel|tél|call|fax|mobile|cell|telefon|teléfono|téléphone)\W*(number|no|nr)?\W*\Z"),
}


def luhn(digits: str) -> bool:
    """Whether a number's check sum holds."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches that hold, by start, then kind as listed."""
    found = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        # What can stand before the sign begins after all else, and after the match before it.
        low = at
        while low > end and (text[low - 1].isalnum() and text[low - 1].isascii() or text[low - 1] in "._%+-"):
            low -= 1
        match = EMAIL.match(text, low) if low < at else None
        if match:
            end = match.end()
            found.append((match.start(), end, 0))
        at += 1
    if re.search("[0-9]", text):
        for m in _IP_RUNS.finditer(text):
            if all(_small(p) for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that may hold an entity: words with digits or address signs and their neighbours, apart from each other."""
    begin = end = -1
    for m in _HOT.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        for _ in range(2):  # the word itself and the one before it
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            b = a
            while a > 0 and text[a - 1] == " ":
                a -= 1
        a = b
        z = m.end()
        for _ in range(8 if m[0][0] not in "0123456789@" else 1):
            while z < len(text) and not text[z].isspace():
                z += 1
            y = z
            while z < len(text) and text[z] == " ":
                z += 1
        z = y
        if end >= 0 and a <= end + 1:
            end = max(end, z)
        else:
            if end >= 0:
                yield begin, end
            begin, end = a, z
    if end >= 0:
        yield begin, end


def _candidates(text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Token boundaries of a stretch, and its candidate segments (first, past-last boundary, kind, features)."""
    bounds = [begin]
    bounds += [m.end() for m in _TOKEN.finditer(text, begin, end)]
    out = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        number = first in "+(" or "0" <= first <= "9"
        word = first.isascii() and first.isalnum()
        if not number and not word:
            continue
        if i and text[bounds[i] - 1].isalnum() and first.isalnum():
            continue
        digits = 0
        sign = False
        for j in range(i + 1, min(len(bounds), i + LONGEST + 1)):
            token = text[bounds[j - 1] : bounds[j]]
            if token[0] in "\n\r" or len(token) > 1 and token.isspace():
                break
            digits += len(token) if "0" <= token[0] <= "9" else 0
            sign = sign or token in ("@", "at", "AT")
            last = token[-1]
            if not (last.isascii() and last.isalnum()) or bounds[j] < len(text) and text[bounds[j]].isalnum():
                continue
            span = text[bounds[i] : bounds[j]]
            if sign and word:
                if "@" in span and EMAIL.fullmatch(span) or "@" not in span and _SPELLED.fullmatch(span):
                    out.append((i, j, "email", _features(text, bounds[i], bounds[j], span, "email")))
            elif number and "0" <= last <= "9" and not re.search(r"[^0-9 ().+-]", span):
                if IP.fullmatch(span):
                    out.append((i, j, "ip", _features(text, bounds[i], bounds[j], span, "ip")))
                elif 13 <= digits <= 19 and "+" not in span and "(" not in span:
                    out.append((i, j, "card", _features(text, bounds[i], bounds[j], span, "card")))
                if 9 <= digits <= 15:
                    out.append((i, j, "phone", _features(text, bounds[i], bounds[j], span, "phone")))
            elif not sign and digits > 19:
                break
    return bounds, out


def _features(text: str, begin: int, end: int, span: str, kind: str) -> list[str]:
    """Names of the features of a whole span under a kind."""
    digits = _digits(span)
    out = ["bias", f"digits={min(len(digits), 20)}"]
    cue = bool(_CUES[kind].search(text[max(0, begin - BEFORE) : begin]))
    out.append(f"cue={cue}")
    before, after = text[begin - 1 : begin], text[end : end + 1]
    out.append("tight" if before and before in ".-+@/=\"_#" or after and after in "-@/=\"_" else "free")
    if kind == "email":
        sign = "plain" if "@" in span else "bracket" if re.search(r"[\[(]", span) else "spelled"
        out += [f"sign={sign}", f"parts={min(4, len(re.split(r'[.]|dot', span)))}"]
        return out
    if kind == "ip":
        return [*out, f"small={all(_small(p) for p in span.split('.'))}"]
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", span)[:6])
    seps = "".join(sorted(set(re.sub("[0-9]", "", span))))
    balanced = span.count("(") == span.count(")")
    out += [f"groups={groups}", f"seps={seps}", f"balanced={balanced}"]
    if kind == "card":
        return [*out, f"luhn={luhn(digits)}", f"luhn={luhn(digits)}&cue={cue}"]
    start = "plus" if span[0] == "+" else "zeros" if span.startswith("00") else "other"
    return [*out, f"start={start}", f"start={start}&cue={cue}", f"cue={cue}&separated={bool(seps)}"]


def _lattice(n: int, segments: list, weights: dict) -> tuple[list[list], list[float]]:
    """Segments with scores by their end; log-sums of all segmentations up to each boundary. Other tokens score 0."""
    by_end: list[list] = [[] for _ in range(n + 1)]
    for s in segments:
        by_end[s[1]].append((s[0], s[2], s[3], sum(weights.get((s[2], f), 0.0) for f in s[3])))
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        terms = [alpha[j - 1], *(alpha[i] + w for i, _, _, w in by_end[j])]
        top = max(terms)
        alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return by_end, alpha


def _marginals(n: int, by_end: list[list], alpha: list[float]) -> Iterator[tuple[int, int, str, list[str], float]]:
    """(first, end, kind, features, probability) of each segment."""
    by_start: list[list] = [[] for _ in range(n + 1)]
    for j, segments in enumerate(by_end):
        for i, kind, features, w in segments:
            by_start[i].append((j, kind, features, w))
    beta = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        terms = [beta[i + 1], *(beta[j] + w for j, _, _, w in by_start[i])]
        top = max(terms)
        beta[i] = top + math.log(sum(math.exp(t - top) for t in terms))
    for i, segments in enumerate(by_start):
        for j, kind, features, w in segments:
            yield i, j, kind, features, math.exp(min(0.0, alpha[i] + w + beta[j] - alpha[n]))


def train(examples: list[tuple[str, int, int, list[tuple[int, int, str]]]], seed: int = 0) -> dict[tuple[str, str], float]:
    """Weights by (kind, feature), fitted to stretches (text, begin, end, spans) by stochastic ascent of the likelihood."""
    rows = []
    for text, begin, end, spans in examples:
        bounds, segments = _candidates(text, begin, end)
        if segments:
            rows.append((len(bounds) - 1, segments, {(bounds.index(a), bounds.index(b), k) for a, b, k in spans if a in bounds and b in bounds}))
    weights: dict[tuple[str, str], float] = defaultdict(float)
    squares: dict[tuple[str, str], float] = defaultdict(lambda: 1e-6)
    order = random.Random(seed)
    for _ in range(PASSES):
        order.shuffle(rows)
        for n, segments, gold in rows:
            gradient: dict[tuple[str, str], float] = defaultdict(float)
            for i, j, kind, features, p in _marginals(n, *_lattice(n, segments, weights)):
                for f in features:
                    gradient[kind, f] += ((i, j, kind) in gold) - p
            for f, g in gradient.items():
                g -= PRIOR * weights[f]
                squares[f] += g * g
                weights[f] += STEP * g / math.sqrt(squares[f])
    return dict(weights)


def decode(text: str, weights: dict[tuple[str, str], float]) -> list[tuple[int, int, str]]:
    """The spans of the best segmentation of each stretch that are sure."""
    out = []
    for begin, end in zones(text):
        bounds, segments = _candidates(text, begin, end)
        if not segments:
            continue
        n = len(bounds) - 1
        by_end, alpha = _lattice(n, segments, weights)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, _, w in by_end[j]:
                if best[i] + w > best[j]:
                    best[j], back[j] = best[i] + w, (i, kind)
        chosen, j = set(), n
        while j > 0:
            if back[j]:
                chosen.add((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        if chosen:
            out += [(bounds[i], bounds[j], k) for i, j, k, _, p in _marginals(n, by_end, alpha) if (i, j, k) in chosen and p >= SURE]
    return sorted(out)


def _rewritten(text: str, spans: list[tuple[int, int, str]], order: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with its entities written in other ways, and where they are now."""
    out, at, found = "", 0, []
    for a, b, kind in spans:
        if a < at:
            continue
        span = text[a:b]
        out += text[at:a]
        if kind == "phone":
            cue = order.choice(("tel ", "Phone: ", "call ", "Tel. ", "fax: "))
            span = order.choice((span.lstrip("+"), "00" + span.lstrip("+"), re.sub("^[+][0-9]+ ", "", span)))
            out += cue
            kind = kind if len(_digits(span)) >= 9 else ""
        elif kind == "email":
            sign, dot = order.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", ".")))
            span = span.replace("@", sign)
            head, tail = span.split(sign)
            span = head.replace(" ", "") + sign + tail.replace(".", dot)
        elif kind == "card":
            span = re.sub("(.{4})(?=.)", lambda m: m[1] + " ", _digits(span))
        if kind:
            found.append((len(out), len(out) + len(span), kind))
        out += span
        at = b
    return out + text[at:], found


def fit(docs: DataFrame) -> dict[tuple[str, str], float]:
    """A field trained on a bounded sample of ``docs``.

    Of the texts with a digit or sign about ``TRAIN_DOCS`` are chosen by a hash,
    each once; of all stretches in them that may hold an entity about
    ``TRAIN_STRETCHES``, by a hash again. It doesn't depend on partitions.
    """
    hot = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    n = hot.count()
    if not n:
        return {}
    # Stretches only: a sampled text may be long. Each is cut in its task, with its surroundings.
    sample = hot.where(F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1 << 20)) < int(min(1.0, TRAIN_DOCS / n) * (1 << 20))).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = base_spans(text)
                for a, b in zones(text):
                    low, high = max(0, a - BEFORE), min(len(text), b + BEFORE)
                    inside = [(s - low, e - low, k) for s, e, k in spans if s >= a and e <= b]
                    rows.append((text[low:high], a - low, b - low, [x[0] for x in inside], [x[1] for x in inside], [x[2] for x in inside]))
            yield pd.DataFrame(rows, columns=["text", "a", "b", "starts", "ends", "kinds"])

    stretches = sample.mapInPandas(cut, "text string, a int, b int, starts array<int>, ends array<int>, kinds array<string>").dropDuplicates(["text", "a", "b"])
    share = min(1.0, TRAIN_STRETCHES / max(1, stretches.count()))
    got = stretches.where(F.pmod(F.xxhash64("text", "a", "b"), F.lit(1 << 20)) < int(share * (1 << 20))).collect()
    order = random.Random(1)
    examples = []
    for r in sorted(got, key=lambda r: (r["text"], r["a"])):
        spans = []
        for s in zip(r["starts"], r["ends"], r["kinds"], strict=True):
            if not spans or s[0] >= spans[-1][1]:
                spans.append(s)
        examples.append((r["text"], r["a"], r["b"], spans))
        if spans:
            text, moved = _rewritten(r["text"], spans, order)
            examples.append((text, 0, len(text), moved))
    return train(examples)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found) for each row of ``docs`` (doc_id, text, ...).

    The counts and the digest are of the patterns' spans; spans has these and
    those that the field adds where no other span is, as kind:start:end in code
    points, end exclusive. A null text is empty and has none. The field is
    trained on ``docs`` unless given. Repeated rows are searched each; other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else fit(docs))  # a few hundred weights

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text)
                added = []
                for a, b, k in decode(text, field.value):
                    if all(b <= s or a >= e for s, e, _ in base):
                        added.append((a, b, k))
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), len(base) + len(added)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_found"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.mapInPandas(search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long")
