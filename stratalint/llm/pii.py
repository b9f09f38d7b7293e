"""PII (7): weak supervision finds personal data beyond the base rules.

Base rules find emails, IPv4 addresses, payment cards and phone numbers; their spans always stay. A generous second set
of patterns proposes candidates: emails that are written out, IPv6 and masked addresses, cards with other separators,
national numbers and numbers within longer runs, and matches that failed a base rule's check. Five labelers vote 1, 0 or
-1 on each candidate and base span, each from a source of its own: the base rule (for only), a test of form (checksum,
octets, digits), a gazetteer (top-level domains, address blocks, card issuers with their lengths, country and area
codes), words before it, and its edges. Votes and two coarse features make a pattern, of which there are at most
4 * 3^5 * 32, so the corpus's counts by pattern are bounded. From them expectation-maximisation estimates each labeler's
reliability for each kind: base spans are seeds, an abstention tells nothing. The posteriors train a logistic classifier
on all votes but the base rule's. Candidates that it gives more than ACCEPT become spans; only then are overlaps
resolved, by score in hundredths. Whole texts are scanned, every pattern in time linear in the text.

Null text: empty, no spans. Null doc_id and repeated rows: scanned like others. Empty table: empty result. Ties of score
go to the earlier, then the longer span. `redact_documents` carries all other columns. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, parts_of, release, spread_row, stage, table, whole_row

KINDS = ["email", "ip", "card", "phone"]
LABELERS, ACCEPT, ROUNDS, SEED = 5, 0.9, 60, 0.97
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every span and candidate has: a digit, an @, a colon, or a written-out at or dot.
_SOME = re.compile(r"[0-9@:]|[(\[{] ?at ?[)\]}]|[ (\[{]dot[ )\]}]", re.I)
#: Candidates beyond the base rules. Every repetition is bounded or runs over disjoint classes; written-out emails are
#: looked for only around such an at or dot.
_TRIGGER = re.compile(r"[(\[{] ?at ?[)\]}]|[ (\[{]dot[ )\]}]", re.I)
_AT, _DOT = r"(?: ?[(\[{] ?at ?[)\]}] ?|@| at )", r"(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)"
_WRITTEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}(?![A-Za-z0-9-])", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_HEX = "[0-9A-Fa-f]{1,4}"
_SIX = re.compile(rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{2,7}}{_HEX}|(?:{_HEX}:){{1,6}}:{_HEX}(?::{_HEX}){{0,5}})(?![0-9A-Za-z:])")
_MASKED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])")
_SPACED = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}(?![0-9])")
_GROUP = re.compile(r"[0-9]+")
_PLAIN = re.compile(r"(?<![0-9.+-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9.+/-])\(?0[1-9][0-9]{1,3}\)?[ /.-]{1,3}[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_WORDS = {
    0: re.compile(r"mail|contact|kontakt|correo|courriel|write|schreib|reach"), 1: re.compile(r"\bip\b|host|server|address|adress|direcci|client|login"),
    2: re.compile(r"card|karte|carte|tarjeta|visa|master|credit|pay"), 3: re.compile(r"phone|\btel|call|fax|mobil|anruf|appel|llam|t[ée]l|ring"),
}
_AGAINST = re.compile(r"version|\bv$|isbn|issn|order|section|figure|page|invoice|doi|\bid\b|build|serial|ticket|part\b|no\.? ?$|nr\.? ?$|# ?$")
_ENDS = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu it nl ch at be ru cn jp in br ca au se no dk fi pl pt ie nz mx ar app dev me tv".split())
#: Card issuers: the range of the first six digits, and the lengths.
_ISSUERS = [(400000, 499999, (13, 16, 19)), (510000, 559999, (16,)), (222100, 272099, (16,)), (340000, 349999, (15,)), (370000, 379999, (15,)), (601100, 601199, (16, 17, 18, 19)), (644000, 659999, (16, 17, 18, 19)),
            (352800, 358999, (16, 17, 18, 19)), (300000, 305999, (14,)), (309500, 309599, (14,)), (360000, 360999, (14,)), (361000, 369999, (14,)), (380000, 399999, (14, 16)), (620000, 629999, (16, 17, 18, 19)), (500000, 509999, (13, 16, 19)), (560000, 589999, (13, 16, 19))]
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()) | frozenset(
    str(x) for a, b in ((211, 213), (216, 216), (218, 218), (220, 269), (290, 291), (297, 299), (350, 359), (370, 378), (380, 383), (385, 387), (389, 389), (420, 421), (423, 423), (500, 509), (590, 599), (670, 670), (672, 692), (800, 800), (808, 808), (850, 850), (852, 853), (855, 856), (870, 870), (880, 880), (886, 886), (960, 968), (970, 977), (979, 979), (992, 996), (998, 998)) for x in range(a, b + 1)
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-4:] or 0) <= 255 if len(x) < 5 else len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Base matches, and as False local@label without a dot: the leftmost match starts where the run before an @ does."""
    last, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < at:
            if m := _DOMAIN.match(text, at + 1):
                yield i, m.end(), True
                last = m.end()
                at = text.find("@", last)
                continue
            if m := _LABEL.match(text, at + 1):
                yield i, m.end(), False
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans (kind, start, end), and the matches that failed a base check."""
    out, failed = [], []
    if "@" in text:
        for a, b, ok in _emails(text):
            (out if ok else failed).append((0, a, b))
    for m in _IP.finditer(text):
        (out if _octets(m[0]) else failed).append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19:
                (out if luhn(d) else failed).append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_digits(m[0]))
            (out if 9 <= n <= 15 else failed).append((3, *m.span()))
    return out, failed


def candidates(text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What else may be personal data, in order; they may overlap each other, but no base span."""
    found = set(failed)
    for kind, p in ((1, _SIX), (1, _MASKED), (2, _SPACED), (3, _PLAIN), (3, _NATIONAL)):
        found |= {(kind, *m.span()) for m in p.finditer(text)}
    for kind, a, b in failed:
        n = 0
        for m in _GROUP.finditer(text, a, b) if kind == 3 else ():  # a run of too many digits: a number may end at any group
            n += m.end() - m.start()
            if n > 15:
                break
            if n >= 9:
                found.add((3, a, m.end()))
    last = 0
    for t in _TRIGGER.finditer(text):
        if t.start() >= last:  # else it was in a match's window already
            last = t.start() + 200
            found |= {(0, *m.span()) for m in _WRITTEN.finditer(text, max(0, t.start() - 160), last + 200)}
    taken = sorted((a, b) for _, a, b in base)
    starts, stops = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    # an earlier base span that ends after the start, or one that starts within
    free = lambda a, b: (i := bisect.bisect_left(starts, b)) == 0 or stops[i - 1] <= a
    return sorted(x for x in found if free(x[1], x[2]))


def _block(s: str) -> int:
    """What the address plan says: 1 of public blocks, 0 of private ones, -1 of reserved ones."""
    if ":" in s:
        head = int(s.split(":")[0], 16)
        return 1 if head >> 13 == 1 else 0 if head >> 8 in (0xFC, 0xFD, 0xFE) else -1
    a, b = [int(x[-4:]) for x in re.findall(r"[0-9]+", s)[:2]]
    if a == 0 or a >= 224:
        return -1
    return 0 if a in (10, 127) or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else 1


def _code_of(s: str, d: str) -> int:
    """What numbering plans say of a phone number."""
    if s[0] == "+" or s.startswith("00"):
        d = d.removeprefix("00")
        known = next((d[:n] for n in (1, 2, 3) if d[:n] in _COUNTRIES), None)
        return -1 if not known or known == "1" and len(d) != 11 else 1
    if len(d) == 10 and d[0] != "0":
        return 1 if d[0] in "23456789" and d[3] in "23456789" and d[1:3] != "11" else -1
    return 0


def pattern(text: str, kind: int, a: int, b: int, rule: int) -> int:
    """The votes and features of a span, as one integer. rule: 1 of a base span, else 0."""
    s, before = text[a:b], text[max(0, a - 40) : a].lower()
    d = _digits(s)
    if kind == 0:
        parts = [x for x in re.split(r"[^A-Za-z0-9-]+", s) if x and x.lower() not in ("at", "dot")]
        tail = parts[-1].lower() if parts else ""
        shape = 1 if tail.isalpha() and 1 < len(tail) < 12 and len(parts) > 2 and any(c.isalpha() for c in parts[0]) else -1
        gazette = 1 if tail in _ENDS else -1
    elif kind == 1:
        if ":" in s:
            groups = s.replace("::", ":0:").split(":")
            shape = 1 if len(groups) == 8 or "::" in s and len(groups) < 8 else -1
        else:
            plain = re.sub(r"[\[\]()]", "", s)
            shape = 1 if _octets(plain) and not re.search(r"(?:^|\.)0[0-9]", plain) else -1
        gazette = _block(s)
    elif kind == 2:
        shape = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        gazette = 1 if any(lo <= int(d[:6]) <= hi and len(d) in sizes for lo, hi, sizes in _ISSUERS) else -1
    else:
        shape = 1 if 9 <= len(d.removeprefix("00")) <= 15 and len(set(d)) > 2 else -1
        gazette = _code_of(s, d)
    context = -1 if _AGAINST.search(before[-16:]) else 1 if _WORDS[kind].search(before) else 0
    edge = (text[a - 1].isalnum() if a else False) or (text[b].isalnum() if b < len(text) else False)
    votes = (rule, shape, gazette, context, -1 if edge else 1)
    out = kind
    for v in votes:
        out = out * 3 + v + 1
    return (out * 8 + min(7, (b - a) // 5)) * 4 + min(3, 4 * len(d) // (b - a))


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    share, size, p = p % 4, p // 4 % 8, p // 32
    votes = np.stack([p // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], 1)
    return p // 3**LABELERS, votes, size, share


class Model:
    """Reliabilities by expectation-maximisation, then a logistic classifier, both from counts by pattern."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(patterns)
        self.patterns, w = patterns[order].astype(np.int64), counts[order].astype(np.float64)
        kind, votes, size, share = _unpack(self.patterns)
        base = votes[:, 0] == 2
        post = np.where(base, SEED, 1 / (1 + np.exp(-1.5 * (votes[:, 1:] - 1).sum(1))))
        self.reliability: dict[str, np.ndarray] = {}
        for k in np.unique(kind):
            own = kind == k
            v, c, q, seed = votes[own], w[own], post[own], base[own]
            for _ in range(ROUNDS):
                # M: how often a labeler that votes votes for and against, by class, with a few counts in advance
                theta = np.array([[[4.0, 1.0], [0.5, 8.0]]] * LABELERS)
                for i in range(LABELERS):
                    for j, x in ((0, 0), (1, 2)):
                        theta[i, 1, j] += (c * q)[v[:, i] == x].sum()
                        theta[i, 0, j] += (c * (1 - q))[v[:, i] == x].sum()
                theta /= theta.sum(2, keepdims=True)
                # E: posteriors of candidates; a labeler that abstains tells nothing, and the base rule only of its own spans
                free = ~seed
                prior = ((c * q)[free].sum() + 1) / (c[free].sum() + 2)
                log = np.full(len(q), np.log(prior / (1 - prior)))
                for i in range(1, LABELERS):
                    for j, x in ((0, 0), (1, 2)):
                        log += np.where(v[:, i] == x, np.log(theta[i, 1, j] / theta[i, 0, j]), 0)
                q = np.where(seed, SEED, 1 / (1 + np.exp(-np.clip(log, -30, 30))))
            post[own], self.reliability[KINDS[k]] = q, theta
        x = self._features(kind, votes, size, share)
        beta = np.zeros(x.shape[1])
        for _ in range(25 if len(w) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
            beta += np.linalg.solve(h, x.T @ (w * (post - p)) - beta)
        self.score = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        self.accepted = {p: float(y) for p, y, b in zip(self.patterns.tolist(), self.score, base) if y > ACCEPT and not b}

    @staticmethod
    def _features(kind: np.ndarray, votes: np.ndarray, size: np.ndarray, share: np.ndarray) -> np.ndarray:
        hot = lambda a, n: np.eye(n)[a]
        by_kind = [hot(kind, 4)[:, k : k + 1] * np.concatenate([hot(votes[:, i], 3) for i in range(1, LABELERS)], 1) for k in range(4)]
        return np.concatenate([hot(kind, 4), *by_kind, hot(size, 8), hot(share, 4)], 1)


def _scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and base spans and candidates with their patterns, candidates marked by a pattern >= 0."""
    if not text or not _SOME.search(text):
        return [], []
    base, failed = base_spans(text)
    out = [(*x, -1 - pattern(text, *x, 1)) for x in base]
    out += [(*x, pattern(text, *x, 0)) for x in candidates(text, base, failed)]
    return base, out


def chosen(voted: list[tuple[int, int, int, int]], accepted: dict[int, float]) -> list[tuple[int, int, int]]:
    """The base spans, and of the accepted candidates (kind, start, end, pattern) those that overlap no better one."""
    out = [x[:3] for x in voted if x[3] < 0]
    starts: list[int] = []
    taken: dict[int, int] = {}
    for kind, a, b, p in sorted((x for x in voted if x[3] in accepted), key=lambda x: (-round(accepted[x[3]], 2), x[1], -x[2], x[0])):
        i = bisect.bisect_left(starts, b)
        if i == 0 or taken[starts[i - 1]] <= a:
            bisect.insort(starts, a)
            taken[a] = b
            out.append((kind, a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_FOUND = "base string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", more array<struct<kind:int,start:long,stop:long,pattern:long>>"
_MORE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("pattern", pa.int64())]))


def _find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, "text"):
        base, n, more = [], [], []
        for text in b.column("text").to_pylist():
            spans, all_ = _scan(text)
            base.append(_joined(spans))
            n.append([sum(k == i for k, _, _ in spans) for i in range(4)])
            more.append([dict(zip(("kind", "start", "stop", "pattern"), x)) for x in all_])
        cols = [pa.array([x[i] for x in n], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.string()), *cols, pa.array(more, _MORE)], names=["doc_id", "base", *[f"n_{k}" for k in KINDS], "more"])
    release()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, their numbers and all voted spans; one row per document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, f"doc_id long, {_FOUND}")


def fit(found: DataFrame) -> Model:
    """The model from all documents' counts by pattern."""
    p = F.explode("more.pattern")
    rows = found.select(p.alias("p")).groupBy(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("p")).count().toArrow()
    return Model(rows.column("p").to_numpy(), rows.column("count").to_numpy())


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (the base spans), n_email, n_ip, n_card, n_phone, spans (all spans); spans as kind:start:end, comma-joined."""
    found = stage(find(docs))
    accepted = fit(found).accepted

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans = []
            for base, more in zip(b.column("base").to_pylist(), b.column("more").to_pylist()):
                if not any(x["pattern"] in accepted for x in more):
                    spans.append(base)
                else:
                    spans.append(_joined(chosen([(x["kind"], x["start"], x["stop"], x["pattern"]) for x in more], accepted)))
            keep = [c for c in b.schema.names if c != "more"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(spans, pa.string())], names=[*keep, "spans"])

    return found.mapInArrow(run, "doc_id long, base string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")


def redact(text: str | None, accepted: dict[int, float]) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by its kind in brackets."""
    spans = sorted((a, -b, k) for k, a, b in chosen(_scan(text or "")[1], accepted))
    if not spans:
        return text
    out, last = [], 0
    for a, b, k in spans:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, -b)
    return "".join([*out, text[last:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all else, n_chars included if it is there, follows the new text or stays."""
    accepted = fit(find(docs)).accepted

    def redacted(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([redact(x, accepted) for x in some], pa.string()) for some in parts_of(texts))])

    new = docs.select(whole_row(docs), F.arrow_udf(redacted, "string").asNondeterministic()("text").alias("_text"))
    put = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return new.select(*spread_row(new, docs.columns, put=put))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    n = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", n.alias("n_spans"))
