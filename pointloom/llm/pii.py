"""Personal data by fixed patterns and by a linear-chain conditional random field over word shapes.

The field is trained here from a small labelled table (``labelled_rows``) and decoded by Viterbi in numpy, many
stretches at once. It labels e-mail addresses (also spelled-out ones), IP addresses, card numbers, phone numbers,
social-security numbers and bank account numbers. All of these hold a digit, an @, a bracketed at, or an at, a word and
a dot; only stretches of ``REACH`` characters around such a sign are decoded.

Every finding of the patterns stays; one of the field is added where it overlaps none of them and has a plausible
form. Null text counts as empty; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: The first four are the patterns' kinds, in the order for ties.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
REACH = 48
#: Tokens that are decoded together, with those that sequences are padded by; a longer sequence is decoded alone.
CELLS = 1 << 14

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[\w.%+-]+ ?(?:@|[\[(]at[\])]) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]|dot) ?[\w-]+)+|[\w.%+-]+ at [\w-]+(?: dot [\w-]+)+", re.I)
#: The spelled form of _SPELLED counts whole, so that all of an address of any length is decoded.
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]|(?<= )at [\w-]+(?: dot [\w-]+)+", re.I)
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\S")


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in odd)) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str):
    """Matches of _EMAIL, found from each @ so that long runs without one cost nothing."""
    at = text.find("@")
    done = 0
    while at >= 0:
        start = max(done, _LOCAL.search(text, max(done, at - 256), at).start())
        if start == max(done, at - 256) and start > done:
            start = _LOCAL.search(text, done, at).start()
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings; leftmost, non-overlapping within a kind, failing matches dropped."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


# ---- the conditional random field


def shape(token: str) -> str:
    """Word shape: letters to X or x, digits to 9, runs of over three cut to three (digits keep their count up to 19)."""
    if token[0].isdigit():
        return f"9*{min(len(token), 20)}"
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in token[:12])
    return re.sub(r"(X{3}|x{3})\w*", r"\1", s)


#: Words that tell kinds apart; all others are known by their shape only.
CUES = frozenset("at dot com org net example mail email phone tel call fax mobile cell ssn social security iban account bank card visa credit pay ip host server address version order invoice no nr page chapter".split())


def features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    shapes = ["<"] * 2 + [shape(t) for t, _, _ in tokens] + [">"] * 2
    cues = [w if (w := t.lower()) in CUES else "" for t, _, _ in tokens]
    out = []
    for i, (_, s, e) in enumerate(tokens):
        a, b, c, d, f = shapes[i : i + 5]
        glued = ("g" if i and tokens[i - 1][2] == s else "s") + ("g" if i + 1 < len(tokens) and tokens[i + 1][1] == e else "s")
        fs = ["1", f"0{c}", f"-{b}", f"+{d}", f"={a}", f"~{f}", f"-0{b}|{c}", f"0+{c}|{d}", f"-+{b}|{c}|{d}", f"g{glued}", f"gc{glued}{c}"]
        fs += [f"c{k}{cues[i + k]}" for k in (-3, -2, -1, 0, 1, 2) if 0 <= i + k < len(tokens) and cues[i + k]]
        out.append(fs)
    return out


class Field:
    """Weights: a row for each feature, a column for each label; and label to label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, tokens) -> np.ndarray:
        get, out = self.names.get, np.empty((len(tokens), len(LABELS)))
        for at in range(0, len(tokens), 4096):  # a token's features depend on three to either side
            first = max(0, at - 3)
            some = features(tokens[first : at + 4099])[at - first :]
            for i, fs in enumerate(some[:4096], at):
                out[i] = self.emit[[k for f in fs if (k := get(f)) is not None]].sum(0)
        return out

    def decode(self, many: list[list[tuple[str, int, int]]]) -> list[np.ndarray]:
        """Best labels of several token sequences; those of similar length are decoded together, ``CELLS`` tokens at most."""
        out: list = [None] * len(many)
        order = sorted(range(len(many)), key=lambda k: len(many[k]))
        while order:
            longest = len(many[order[-1]])
            batch = order[-max(1, CELLS // max(1, longest)) :]
            del order[-len(batch) :]
            emit = np.zeros((len(batch), longest, len(LABELS)))
            for r, k in enumerate(batch):
                emit[r, : len(many[k])] = self.scores(many[k])
            lens = np.array([len(many[k]) for k in batch])
            emit[:, 0] += [-1e4 * (b[0] == "I") for b in LABELS]  # as in training, no finding begins with an inner label
            best, back = emit[:, 0], np.zeros(emit.shape, np.int8)
            for t in range(1, longest):
                by = best[:, :, None] + self.move
                back[:, t] = by.argmax(1)
                best = np.where((t < lens)[:, None], by.max(1) + emit[:, t], best)
            label = best.argmax(1)
            path = np.zeros((len(batch), longest), np.int8)
            rows = np.arange(len(batch))
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = np.where((t < lens) & (t > 0), back[rows, t, label], label)
            for r, k in enumerate(batch):
                out[k] = path[r, : lens[r]]
        return out


def allowed() -> np.ndarray:
    """Moves between labels: an inner label follows only its own kind."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [a[2:] == b[2:] and a != "O" for a in LABELS]
    return ok


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 70, rate: float = 0.4, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch gradient steps with per-weight rates; rows: text and labelled (start, end, kind)."""
    names: dict[str, int] = {}
    sequences = []
    for text, marked in rows:
        tokens = tokenise(text, 0)
        y = np.zeros(len(tokens), np.int64)
        for s, e, kind in marked:
            inside = [i for i, t in enumerate(tokens) if s <= t[1] and t[2] <= e]
            for n, i in enumerate(inside):
                y[i] = 1 + 2 * KINDS.index(kind) + (n > 0)
        if tokens:
            sequences.append(([[names.setdefault(f, len(names)) for f in fs] for fs in features(tokens)], y))
    n, longest, k = len(sequences), max((len(y) for _, y in sequences), default=1), len(LABELS)
    flat = np.array([f for fs, _ in sequences for t in fs for f in t], np.int64)
    where = np.array([r * longest + i for r, (fs, _) in enumerate(sequences) for i, t in enumerate(fs) for _ in t], np.int64)
    gold, mask = np.zeros((n, longest, k)), np.zeros((n, longest), bool)
    for r, (_, y) in enumerate(sequences):
        gold[r, np.arange(len(y)), y], mask[r, : len(y)] = 1, True
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    ok = allowed()
    start = np.array([float(b[0] != "I") for b in LABELS])
    seen = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]
    gold_move = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:])
    places, first = np.unique(where, return_index=True)  # features of a place stand together
    by_feature = np.argsort(flat, kind="stable")
    begin = np.searchsorted(flat[by_feature], np.arange(len(names)))
    for _ in range(steps):
        score = np.zeros((n * longest, k))
        score[places] = np.add.reduceat(emit[flat], first)
        score = np.exp((score - score.max(1, keepdims=True)).reshape(n, longest, k))
        score[:, 0] *= start
        trans = np.where(ok, np.exp(move), 0)
        ahead, after = np.zeros_like(score), np.ones_like(score)  # each scaled to sum 1
        ahead[:, 0] = score[:, 0] / score[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            a = (ahead[:, t - 1] @ trans) * score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = (score[:, t + 1] * after[:, t + 1]) @ trans.T
            after[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1)
        there = ahead * after
        there *= mask[:, :, None] / there.sum(2, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(1, longest):
            right = score[:, t] * after[:, t]
            whole = np.einsum("ri,ij,rj->r", ahead[:, t - 1], trans, right)
            pairs += (ahead[:, t - 1] * (mask[:, t] / np.maximum(whole, 1e-300))[:, None]).T @ right * trans
        by_place = (gold - there).reshape(-1, k)
        g_emit = np.add.reduceat(by_place[where[by_feature]], begin)
        for w, g, s in ((emit, g_emit - decay * n * emit, seen[0]), (move, (gold_move - pairs) * ok - decay * n * move, seen[1])):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(names, emit, np.where(ok, move, -1e4))


def tokenise(text: str, at: int) -> list[tuple[str, int, int]]:
    return [(m[0], m.start() + at, m.end() + at) for m in _TOKEN.finditer(text)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Where signs of personal data are, with REACH characters and the rest of a token around; overlapping ones are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low = out[-1][1] if out else 0
        a, b = max(low, m.start() - REACH), min(len(text), m.end() + REACH)
        while a > low and not text[a - 1].isspace():
            a -= 1
        if b > low and (space := _SPACE.search(text, b)):
            b = space.start()
        elif b > low:
            b = len(text)
        if out and a <= low:
            out[-1][1] = max(low, b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def plausible(kind: str, text: str) -> bool:
    d = digits_of(text)
    if kind == "email":
        return bool(_SPELLED.fullmatch(text))
    if kind == "ip":
        return len(p := text.split(".")) == 4 and all(x.isdigit() and int(x) <= 255 for x in p if len(x) < 9) and max(map(len, p)) < 4
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 7 <= len(d) <= 15 and bool(re.search(r"[\x20().-]", text.strip()))
    if kind == "ssn":
        return bool(re.fullmatch(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", text))
    compact = re.sub(r"\s", "", text)
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact)) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def findings(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text the patterns' findings, and those with the field's."""
    where, sequences = [], []
    for n, text in enumerate(texts):
        for a, b in stretches(text):
            if tokens := tokenise(text[a:b], a):
                where.append(n)
                sequences.append(tokens)
    extra: list[list] = [[] for _ in texts]
    for n, tokens, labels in zip(where, sequences, field.decode(sequences), strict=True):
        i = 0
        while i < len(tokens):
            if LABELS[labels[i]][0] == "B":
                j = i + 1
                while j < len(tokens) and labels[j] == labels[i] + 1:
                    j += 1
                extra[n].append((tokens[i][1], (labels[i] - 1) // 2, tokens[j - 1][2]))
                i = j
            else:
                i += 1
    out = []
    for text, more in zip(texts, extra, strict=True):
        found = base(text)
        free = sorted(found)
        added, k = [], 0
        taken = [(s, e) for s, _, e in free]
        for s, kind, e in sorted(more):
            while k < len(taken) and taken[k][1] <= s and (k + 1 < len(taken) and taken[k + 1][0] <= s):
                k += 1
            if not any(a < e and s < b for a, b in taken[max(0, k - 3) : k + 6]) and plausible(KINDS[kind], text[s:e]):
                added.append((s, int(kind), e))
        out.append((found, sorted(found + added)))
    return out


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def labelled_rows(seed: int = 7, n: int = 420) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: sentences from templates with values put in, and sentences with harmless numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    names, hosts = "ana bob carla dieter eva frank gina hugo john.smith mary_lee p.jones x99 info".split(), "example mail my-shop uni test-site web7".split()

    def value(kind):
        if kind == "email":
            a, h, t = pick(names), pick(hosts), pick(["com", "org", "net", "de", "co.uk"])
            return pick([f"{a}@{h}.{t}", f"{a}@{h}.{t}", f"{a} at {h} dot {t.split('.')[0]}", f"{a} (at) {h} (dot) {t.split('.')[0]}", f"{a}[at]{h}.{t}", f"{a} [at] {h}.{t}"])
        if kind == "ip":
            return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
        if kind == "card":
            body = pick(["4", "51", "34", "6011"])
            body += num(15 - len(body))
            body += next(str(c) for c in range(10) if luhn(body + str(c)))
            sep = pick(["", " ", "-"])
            return sep.join(body[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            return pick(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+44 {} {} {}", "{} {} {}", "+1-{}-{}-{}"]).format(num(3), num(3), num(4))
        if kind == "ssn":
            return f"{num(3)}-{num(2)}-{num(4)}"
        land, body = pick(["DE", "FR", "ES"]), num(20)
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
        return f"{land}{check:02d}" + pick([" ", ""]) + pick([" ", ""]).join(body[i : i + 4] for i in range(0, 20, 4))

    cue = {"email": ["mail", "write to", "contact", ""], "ip": ["host", "server", "from ip", ""], "card": ["card", "paid with", "visa", ""], "phone": ["call", "tel", "phone:", ""], "ssn": ["ssn", "social security"], "iban": ["iban", "account"]}
    fill = "the of and to in was that for le la der die que un con with sur est und".split()
    plain = ["in {a} years", "version {a}.{b}.{c}", "page {a} of {b}", "order no {d}", "at {a}:{b}", "{a}.{b} percent", "{e} rows", "${a},{e}", "{y}-{m}-{n}", "{n}/{m}/{y}", "chapter {a}.{b}", "id {d}", "see figure {a} at the top", "x{a}y{b}", "sha {h}", "pi is 3.{d}", "call {a} times", "phone model {a}", "@ home", "at the shop dot"]
    rows = []
    for i in range(n):
        left, right = " ".join(pick(fill) for _ in range(int(rng.integers(1, 7)))), " ".join(pick(fill) for _ in range(int(rng.integers(1, 7))))
        if i % 5 < 3:
            kind = KINDS[i % 6] if i % 10 < 6 else pick(KINDS)
            v, c = value(kind), pick(cue[kind])
            head = f"{left} {c} " if c else f"{left} "
            rows.append((head + v + pick([" ", ". ", ", ", "### ", "!! "]) + right, [(len(head), len(head) + len(v), kind)]))
        else:
            v = pick(plain).format(a=num(1 + i % 2), b=num(1), c=num(2), d=num(5 + i % 4), e=num(3), y=f"20{num(2)}", m=num(2), n=num(2), h="".join(pick("0123456789abcdef") for _ in range(40)))
            rows.append((f"{left} {v} {right}", []))
    for i in range(n // 4):  # addresses in words, and sentences that only look like them
        left, right = (" ".join(pick(fill) for _ in range(int(rng.integers(a, 7)))) for a in (0, 0))
        if i % 3:
            made = lambda xs: pick(xs) if rng.integers(2) else "".join(pick("abcdefghilmnoprstuvz") for _ in range(int(rng.integers(3, 9))))
            v = f"{made(names)} at {made(hosts)} dot {pick(['com', 'org', 'net', 'de', 'info', 'co dot uk'])}"
            head = " ".join(x for x in (left, pick(["write to", "mail", "contact", "reach", ""])) if x)
            head += " " * bool(head)
            rows.append((head + v + pick([" ", ". ", ", "]) + right, [(len(head), len(head) + len(v), "email")]))
        else:
            rows.append((f"{left} {pick(['met at noon', 'look at the dot', 'at the shop dot', 'sat at home', 'mail at once'])} {right}", []))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled rows as a table, of fixed size."""
    return spark.createDataFrame([(t, [{"start": s, "end": e, "kind": k} for s, e, k in m]) for t, m in labelled_rows()], "text string, spans array<struct<start:int,end:int,kind:string>>")


def train_on(labelled: DataFrame, most: int = 10_000) -> Field:
    """Train on a labelled table of at most ``most`` rows; a larger one is an error."""
    rows = labelled.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled rows")
    return train([(r.text, [(s.start, s.end, s.kind) for s in r.spans or ()]) for r in rows if r.text])


def find_personal(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, the patterns' counts and digest, and all spans."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        field = held.value

        def run(columns):
            out: list[list] = [[] for _ in range(6)]
            for plain, every in findings([t or "" for t in columns[0]], field):
                kinds = [k for _, k, _ in plain]
                for values, v in zip(out, (*[kinds.count(k) for k in range(4)], hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every)), strict=True):
                    values.append(v)
            return out

        return run

    new = [*[(f"n_{k}", pa.int64(), "long") for k in KINDS[:4]], ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string")]
    return map_arrow(docs, [id_col], [text_col], make, new)
