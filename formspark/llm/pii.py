"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation learns how far to trust
each of them, and a classifier trained on its posteriors decides on the spans beyond the base rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import cut

#: Texts are searched in pieces of about so many bytes.
PIECE = 1 << 18

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = KINDS[:4]

# The base patterns, written so that no start is tried twice: a run of digits or of local-part characters is tried from
# its beginning only, which finds the same leftmost matches.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider nets for candidates.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{2,}+(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z]{2,}+)+")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)\x20{0,3}[=:]\x20{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)")
_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at be us ca au jp".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "81", "82", "86", "90", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
NEAR = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "from"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "secret": ("token", "secret", "password", "key", "auth"),
    "id": ("ssn", "social", "security", "passport", "id"),
}
NOT_NEAR = ("version", "isbn", "issn", "order", "page", "figure", "section", "doi", "release")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further spans that may be personal data: (start, kind's index, end), clear of the base spans and of each other."""
    found = []
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
    found += [(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    found += [(m.start(), 5, m.end()) for m in _NUMBER.finditer(text)]
    out, taken = [], sorted((s, e) for s, _, e in base)
    k, done = 0, 0
    for s, kind, e in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= done and not (k < len(taken) and taken[k][0] < e):
            out.append((s, kind, e))
            done = e
    return out


_STRICT = {0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 1: _IP, 2: re.compile(r"(?:[0-9]{4}[\x20-]?){3,4}[0-9]{1,4}"), 3: _PHONE, 4: re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{20,}"), 5: _NUMBER}


def votes(text: str, start: int, kind: int, end: int) -> str:
    """One letter for each labeler: + personal, - not, 0 no opinion."""
    s, d = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40) : start].lower()
    shape = bool(_STRICT[kind].fullmatch(s))
    valid = (s.count(".") > 0 or "dot" in s.lower(), True, luhn(d), 10 <= len(d) <= 15, len(set(s)) >= 8, d[:3] not in ("000", "666") and d[:1] != "9")[kind] if s else False
    listed = (s.rpartition(".")[2].lower() in TOP_DOMAINS, d[:1] != "0", d.startswith(ISSUERS), s[:1] == "+" and d.startswith(CALLING_CODES), None, None)[kind]
    near = 1 if any(w in before for w in NEAR[KINDS[kind]]) else -1 if any(w in before for w in NOT_NEAR) else 0
    edge = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    size = ((6, 80), (7, 15), (13, 23), (10, 20), (20, 80), (11, 11))[kind]
    long = size[0] <= len(s) <= size[1]
    return "".join("+" if v is True or v == 1 and v is not False else "0" if v is None or v is not False and v == 0 else "-" for v in (shape, valid, listed, near, edge, long))


LABELERS = ("shape", "valid", "listed", "near", "edge", "size")
_VOTE = "-0+"
_SPAN = "array<struct<start:int,kind:int,end:int,votes:string>>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {_SPAN}, more {_SPAN}"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.string())]))
    for batch in ta.chunks(batches, limit=PIECE):
        n, sha, base, more = [[] for _ in BASE], [], [], []
        for x in batch.column(1):
            text = x.as_py() or ""
            own = base_spans(text)
            for k in range(len(BASE)):
                n[k].append(sum(1 for _, kind, _ in own if kind == k))
            sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest())
            voted = [[{"start": s, "kind": k, "end": e, "votes": votes(text, s, k, e)} for s, k, e in spans] for spans in (own, candidates(text, own))]
            base.append(voted[0])
            more.append(voted[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(sha, pa.string()), pa.array(base, span), pa.array(more, span)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "more"])


def reliabilities(patterns: list[tuple[str, float]], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with their counts: the share of personal spans, the probability
    [class, labeler, vote] of each vote, and the posterior of each pattern. Starts from the majority vote."""
    v = np.array([[_VOTE.index(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    post = sigmoid((v - 1).sum(axis=1) * 1.0)
    for _ in range(rounds):
        share = (n @ post + 1) / (n.sum() + 2)
        table = np.empty((2, v.shape[1], 3))
        for y, p in ((1, post), (0, 1 - post)):
            for vote in range(3):
                table[y, :, vote] = ((n * p) @ (v == vote) + 0.5) / ((n * p).sum() + 1.5)
        logs = np.log(table)
        odds = np.log(share / (1 - share)) + sum(logs[1, j, v[:, j]] - logs[0, j, v[:, j]] for j in range(v.shape[1]))
        post = sigmoid(odds)
    return float(share), table, post


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -60, 60) / 2))


def encode_patterns(patterns: list[tuple[int, str]]) -> np.ndarray:
    x = np.zeros((len(patterns), 1 + len(KINDS) + 2 * len(LABELERS)))
    x[:, 0] = 1
    for i, (kind, p) in enumerate(patterns):
        x[i, 1 + kind] = 1
        for j, c in enumerate(p):
            if c != "0":
                x[i, 1 + len(KINDS) + 2 * j + (c == "+")] = 1
    return x


def span_classifier(patterns: list[tuple[int, str]], n: np.ndarray, post: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on kind and votes, with the posteriors as soft targets."""
    x, t = encode_patterns(patterns), np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    n = n / n.sum() + 1e-6
    for _ in range(50):
        p = sigmoid(x @ t)
        g = x.T @ (n * (p - post)) + ridge * 0.01 * t
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(t)) * ridge * 0.01
        t = t - np.clip(np.linalg.solve(h, g), -3, 3)
    return t


def accepted(found: DataFrame, least: float = 0.9) -> list[tuple[int, str]]:
    """The (kind, votes) that the classifier takes for personal data. Votes are counted over all spans of all texts;
    there are at most 3**6 patterns of a kind, so the counts are of bounded size."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    counted = sorted((r.kind, r.votes, r["count"]) for r in spans.groupBy("s.kind", "s.votes").count().collect())
    if not counted:
        return []
    patterns, n, post = [(k, p) for k, p, _ in counted], np.array([c for *_, c in counted], float), np.zeros(len(counted))
    for kind in range(len(KINDS)):
        own = [i for i, (k, _) in enumerate(patterns) if k == kind]
        if own:
            post[own] = reliabilities([(patterns[i][1], n[i]) for i in own])[2]
    p = sigmoid(encode_patterns(patterns) @ span_classifier(patterns, n, post))
    return [k for k, x in zip(patterns, p) if x >= least and k[1].count("+") >= 3]


def find_private(docs: DataFrame) -> DataFrame:
    """Personal data in every text of docs (doc_id, text): counts and digest of the base spans, and all spans.

    A null text is empty. Spans are in code points, end exclusive. Rows don't depend on each other but for the votes
    that all of them add to the reliabilities; repeated rows count each time.
    """
    found = cut(docs.select("doc_id", "text").mapInArrow(ta.frees(scan), FOUND))
    taken = F.array(*[F.lit(f"{k}{v}") for k, v in accepted(found)]).cast("array<string>")
    spans = F.array_sort(F.concat("base", F.filter("more", lambda s: F.array_contains(taken, F.concat(s["kind"].cast("string"), s["votes"])))))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", said.alias("spans"))


def mask_private(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars, where there is such a column, counted anew."""
    taken = frozenset(accepted(cut(docs.select("doc_id", "text").mapInArrow(ta.frees(scan), FOUND).select("base", "more"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=PIECE):
            at = batch.schema.get_field_index("text")
            out = [None if (t := x.as_py()) is None else _masked(t, taken) for x in batch.column(at)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                field = batch.schema.field(k)
                batch = batch.set_column(k, field, pa.array([None if t is None else len(t) for t in out], field.type))
            yield batch

    return docs.mapInArrow(ta.frees(run), docs.schema)


def _masked(text: str, taken: frozenset[tuple[int, str]]) -> str:
    own = base_spans(text)
    spans = own + [(s, k, e) for s, k, e in candidates(text, own) if (k, votes(text, s, k, e)) in taken]
    if not spans:
        return text
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])
