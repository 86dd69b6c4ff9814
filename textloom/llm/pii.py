"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: outside, then the kinds.
LABELS = 1 + len(KINDS)
#: Buckets of hashed features; the bounded training sample: rows chosen by a hash of the id, of at most so many characters.
FEATURES, SAMPLE_ROWS, SAMPLE_CHARS = 1 << 12, 4000, 20_000
#: Made training texts besides the sample's, steps of training and its rate.
MADE_TEXTS, STEPS, RATE = 1500, 150, 0.3
#: Rounds of message passing, its damping, and the marginal from which a token gets a label.
ROUNDS, DAMPING, SURE = 8, 0.3, 0.9

# Each of these is equal to the plain pattern it stands for, but never tries a start inside a run that has failed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]+")
_SIGNAL = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_EDGES = ".,;:!?\"'()[]{}<>|"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, in the order of kinds and starts."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1  # no local part reaches over a sign
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass
class Graph:
    """Tokens that may be personal data (start, end), links between direct neighbours, and links between distant ones.

    Tokens without a digit or a sign of an address are known to be outside, so the chain falls apart there. A skip link
    joins each token to the last one before it of the same normal form and to the last one that is similar (the same last
    seven digits, the same local part), so that a long chain of repeats stays linear.
    """

    tokens: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", token))


def _short(token: str) -> str:
    return re.sub(r"9+", "9", _shape(token))[:24]


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "replace")) % FEATURES


def _forms(core: str, digits: str) -> list[tuple[str, str]]:
    """The normal forms by which distant tokens are linked: an exact one, and one of similar tokens."""
    if len(digits) >= 7:
        return [("digits", digits), ("tail", digits[-7:])]
    local = re.split(r"@|[\[({]at[\])}]", core.lower(), maxsplit=1)
    return [("whole", core.lower())] + ([("local", local[0])] if len(local) == 2 and len(local[0]) >= 3 else [])


def graph(text: str) -> Graph:
    tokens, features, chain, skip = [], [], [], []
    near, seen = False, {}
    before = ""
    found = _CANDIDATE.finditer(text)
    m = next(found, None)
    while m:
        after = next(found, None)
        raw = m[0]
        if not _SIGNAL.search(raw):
            before, near, m = raw, False, after
            continue
        core = raw.strip(_EDGES) or raw
        shape = _shape(core)
        digits = re.sub(r"[^0-9]", "", core)
        parts = re.split(r"[^0-9]+", core)
        following = after[0] if after and _SIGNAL.search(after[0]) else ""
        i = len(tokens)
        names = [
            ("shape", shape[:32]), ("short", _short(core)), ("digits", str(min(len(digits), 24))), ("signs", "".join(sorted(set(re.sub(r"\w", "", core)[:24])))),
            ("plus", str("+" in raw)), ("letters", str(any(c.isalpha() for c in core))), ("octets", str(len(parts) == 4 and all(0 < len(x) <= 3 for x in parts))),
            ("luhn", str(13 <= len(digits) <= 19 and luhn(digits))), ("before", before.lower().strip(_EDGES)[:16]),
            ("left", _short(before) if near else ""), ("right", _short(following)), ("round", f"{_short(before) if near else ''} {_short(core)} {_short(following)}"),
        ]
        tokens.append(m.span())
        features.append([_bucket(*x) for x in names])
        if near:
            chain.append((i - 1, i))
        linked = {i - 1} if near else set()
        for form in _forms(core, digits):
            j = seen.get(form, -1)
            if j >= 0 and j not in linked:
                skip.append((j, i))
                linked.add(j)
            seen[form] = i
        before, near, m = raw, True, after
    return Graph(tokens, features, chain, skip)


def _together(graphs: list[Graph]) -> Graph:
    """One graph of several that have no link between them."""
    out = Graph([], [], [], [])
    for g in graphs:
        n = len(out.tokens)
        out.tokens += g.tokens
        out.features += g.features
        out.chain += [(i + n, j + n) for i, j in g.chain]
        out.skip += [(i + n, j + n) for i, j in g.skip]
    return out


@dataclass
class Field:
    """A skip-chain conditional random field. weights: feature by label; chain, skip: log potentials of label pairs."""

    weights: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, g: Graph) -> np.ndarray:
        return self.weights[np.array(g.features, np.int64).reshape(len(g.tokens), -1)].sum(axis=1) + self.bias

    def beliefs(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the labels of tokens and of links (chain links first), by loopy sum-product with damped messages
        along chain and skip links. On graphs without a cycle they are exact."""
        node = self.unary(g)
        n = len(g.chain) + len(g.skip)
        links = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
        pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        pairs = np.concatenate([pair, pair.transpose(0, 2, 1)])  # [message, label of source, label of target]
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        messages = np.zeros((2 * n, LABELS))
        for _ in range(ROUNDS if n else 0):
            belief = node.copy()
            np.add.at(belief, target, messages)
            new = _logsumexp((belief[source] - messages[back])[:, :, None] + pairs, 1)
            new -= _logsumexp(new, 1)[:, None]
            messages = DAMPING * messages + (1 - DAMPING) * new
        np.add.at(node, target, messages)
        cavity = node[source] - messages[back]
        joint = cavity[:n, :, None] + pair + cavity[n:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if n else joint
        return np.exp(node - _logsumexp(node, 1)[:, None]), joint / joint.sum(axis=(1, 2), keepdims=True)

    def marginals(self, g: Graph) -> np.ndarray:
        return self.beliefs(g)[0]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of tokens that the field is sure of and that touch no base span; neighbours of one kind are one span."""
        if not _SIGNAL.search(text):
            return []
        g = graph(text)
        p = self.marginals(g)
        best = p.argmax(axis=1)
        covered: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if covered and a < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        linked = set(g.chain)
        out: list[list[int]] = []
        last = -2
        k = 0
        for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE)).tolist():
            a, b = g.tokens[i]
            raw = text[a:b]
            a += len(raw) - len(raw.lstrip(_EDGES.replace("(", "") if best[i] == 4 else _EDGES))
            b -= len(raw) - len(raw.rstrip(_EDGES))
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            if b <= a or k < len(covered) and covered[k][0] < b:
                last = -2
                continue
            if last == i - 1 and (last, i) in linked and out[-1][0] == best[i] - 1 and best[i] >= 3:
                out[-1][2] = b
            else:
                out.append([int(best[i]) - 1, a, b])
            last = i
        return [(k, a, b) for k, a, b in out if _whole(k, text[a:b])]


def _whole(kind: int, span: str) -> bool:
    """Whether the joined tokens are all of such a thing and not a piece of one."""
    digits = sum(c in "0123456789" for c in span)
    return (len(span) >= 6, digits >= 4, 13 <= digits <= 19, 7 <= digits <= 15)[kind]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _variant(rng: random.Random, kind: int, span: str) -> str:
    """Another way to write a piece of personal data, mostly one that the base patterns do not match."""
    if kind == 0:
        local, _, domain = span.partition("@")
        return rng.choice([span, f"{local}@{domain.split('.')[0]}", f"{local}[at]{domain}", f"{local}(at){domain}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local}@[{domain}]", f"{local}@@{domain}"])
    if kind == 1:
        parts = span.split(".")
        broken = [*parts]
        broken[rng.randrange(len(parts))] = str(rng.randint(256, 299))
        return rng.choice([span, ".".join(broken), "[.]".join(parts), "-".join(parts), ".".join([*parts[:3], parts[3] + "/" + str(rng.randint(8, 30))])])
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        k = rng.randrange(len(digits))
        digits = rng.choice([digits, digits[:k] + str((int(digits[k]) + rng.randint(1, 9)) % 10) + digits[k + 1 :]])
        return rng.choice(["", ".", "/", "-", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    split = [tail[:3], tail[3:6], tail[6:]]
    return rng.choice([span, span.lstrip("+"), f"({split[0]}) {split[1]}-{split[2]}", " ".join(split), ".".join(split), "-".join(split), f"00{digits}", tail, f"{split[0]}/{split[1]}{split[2]}", f"+{digits[:1]}_{'_'.join(split)}"])


def _instance(rng: random.Random, kind: int) -> str:
    """A piece of personal data of a usual form."""
    if kind == 0:
        name = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
        return f"{name}{rng.choice(['', '.', '_', '-'])}{rng.choice(['', _digits(rng, 2), name[::-1][:5]])}@{name[:4][::-1]}{rng.choice(['mail', 'post', ''])}{rng.choice(['', '7'])}.{rng.choice(['com', 'org', 'example.com', 'de', 'co.uk'])}".replace(".@", "@")
    if kind == 1:
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == 2:
        head = _digits(rng, rng.choice([15, 15, 15, 17, 18]))
        return next(head + c for c in "0123456789" if luhn(head + c))
    return f"+{rng.choice(['1', '1', '44', '49', '33', '34'])} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"


def _innocent(rng: random.Random) -> str:
    """A token with digits or signs that is no personal data."""
    n = lambda a, b: str(rng.randint(a, b))
    return rng.choice(
        [
            lambda: n(0, 9999), lambda: f"{n(1900, 2099)}-{n(1, 12):0>2}-{n(1, 28):0>2}", lambda: f"{n(1, 28)}/{n(1, 12)}/{n(1900, 2099)}", lambda: f"{n(0, 23)}:{n(0, 59):0>2}:{n(0, 59):0>2}",
            lambda: f"{n(0, 20)}.{n(0, 20)}", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", lambda: f"${n(1, 999)},{n(0, 999):0>3}.{n(0, 99):0>2}",
            lambda: f"{n(0, 999)},{n(0, 999):0>3},{n(0, 999):0>3}", lambda: f"{n(0, 100)}%", lambda: f"978-{n(0, 9)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{n(0, 9)}", lambda: f"#{n(1, 99999)}",
            lambda: f"{rng.getrandbits(160):040x}", lambda: f'"{rng.getrandbits(160):040x}"', lambda: f"{rng.getrandbits(32):08x}-{rng.getrandbits(16):04x}-{rng.getrandbits(16):04x}-{rng.getrandbits(48):012x}",
            lambda: f"@{rng.choice(['news', 'home', 'media', 'param', 'override'])}", lambda: "@", lambda: f"{n(1, 99)}-{n(1, 99)}", lambda: f"a{n(1, 99)}", lambda: f"{n(2, 9)}x{n(2, 9)}", lambda: f"(c) {n(1990, 2030)}",
            lambda: f"1{_digits(rng, 9)}", lambda: f"{n(1, 9)}.{_digits(rng, 12)}", lambda: f"-{_digits(rng, 3)}.{_digits(rng, 8)}", lambda: f"{n(1, 9)}e{n(1, 30)}", lambda: f"§{n(1, 300)}({n(1, 9)})", lambda: f"[{n(1, 99)}]",
        ]
    )()


def _cues(rng: random.Random, kind: int) -> str:
    """Words before a piece of personal data: one that tells its kind, or any."""
    told = (("mail", "e-mail", "write", "contact", "from"), ("address", "host", "server", "ip", "from"), ("card", "visa", "account", "number", "no."), ("phone", "tel", "call", "fax", "mobile"))
    return rng.choice(told[kind]) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))


def made_text(rng: random.Random) -> tuple[str, list[Span]]:
    """A text and its spans: personal data in usual and unusual forms, some of it repeated later on, among other tokens."""
    words, spans, size = [], [], 0

    def put(piece: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            spans.append((kind, size, size + len(piece)))
        words.append(piece)
        size += len(piece) + 1

    def prose() -> None:
        for _ in range(rng.randint(1, 5)):
            put("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))))

    shown: list[tuple[int, str]] = []
    for _ in range(rng.randint(1, 8)):
        prose()
        if rng.random() < 0.5:
            put(_innocent(rng))
            continue
        kind, span = rng.choice(shown) if shown and rng.random() < 0.3 else (k := rng.randrange(len(KINDS)), _instance(rng, k))
        shown.append((kind, span))
        put(_cues(rng, kind))
        put(_variant(rng, kind, span), kind)
    prose()
    return " ".join(words), spans


def varied(text: str, rng: random.Random) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """A sampled text with its base spans written in other ways: the text, those spans, and stretches of unknown kind,
    which look like personal data though no base pattern matches them."""
    out, spans, unknown = [], [], []
    at, size = 0, 0

    def copy(to: int) -> None:
        nonlocal size
        piece = text[at:to]
        for m in re.finditer(r"[^\s]*@[^\s]+|\+?[0-9][0-9 ().-]{5,}[0-9]", piece):
            unknown.append((size + m.start(), size + m.end()))
        out.append(piece)
        size += len(piece)

    for kind, a, b in sorted(base_spans(text), key=lambda x: x[1]):
        if a < at:
            continue
        copy(a)
        new = _variant(rng, kind, text[a:b])
        spans.append((kind, size, size + len(new)))
        out.append(new)
        at, size = b, size + len(new)
    copy(len(text))
    return "".join(out), spans, unknown


def _labelled(text: str, spans: list[Span], unknown: list[tuple[int, int]] = ()) -> tuple[Graph, np.ndarray]:
    """The graph of a text, and the label of each token; -1 where it is not known."""
    g = graph(text)
    y = np.zeros(len(g.tokens), np.int64)
    for value, places in ((-1, [(a, b) for a, b in unknown]), *((k + 1, [(a, b)]) for k, a, b in sorted(spans, key=lambda x: x[1]))):
        i = 0
        starts = [a for a, _ in g.tokens] if len(places) == 1 else None
        for a, b in places:
            i = max(0, bisect.bisect_left(starts, a) - 1) if starts else i
            while i < len(g.tokens) and g.tokens[i][0] < b:
                if a < g.tokens[i][1]:
                    y[i] = value
                i += 1
            i = max(0, i - 1)
    return g, y


def train(texts: list[str], seed: int = 3) -> Field:
    """Fits the whole field, features and both kinds of links together, to made texts and to the sampled ones.

    The base patterns' own matches are masked: most are written in ways that those patterns miss, so that what the field
    learns is not the patterns. Each step takes some texts as one graph and goes up the gradient of the likelihood, what
    is seen less what loopy message passing expects; links to tokens of unknown label are left out.
    """
    rng = random.Random(seed)
    rows = [_labelled(*made_text(rng)) for _ in range(MADE_TEXTS)]
    rows += [_labelled(*varied(t, rng)) for t in texts if _SIGNAL.search(t)]
    rows = [(g, y) for g, y in rows if len(y)]
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros(LABELS), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    parts = ("weights", "bias", "chain", "skip")
    scale = {name: np.full(getattr(field, name).shape, 1e-2) for name in parts}
    # Links hold what neighbours and repeats have in common; without a prior they would outvote the tokens' own features.
    ridge = {"weights": 1e-3, "bias": 0.0, "chain": 1e-2, "skip": 1e-2}
    order: list[int] = []
    for _ in range(STEPS):
        if len(order) < 128:
            order = rng.sample(range(len(rows)), len(rows))
        picked, order = order[:128], order[128:]
        g, y = _together([rows[i][0] for i in picked]), np.concatenate([rows[i][1] for i in picked])
        known = y >= 0
        g.chain, g.skip = ([(i, j) for i, j in own if known[i] and known[j]] for own in (g.chain, g.skip))
        node, joint = field.beliefs(g)
        node[np.flatnonzero(known), y[known]] -= 1
        node[~known] = 0
        grads = {name: np.zeros_like(getattr(field, name)) for name in parts}
        x = np.array(g.features)
        np.add.at(grads["weights"], x.ravel(), np.repeat(node, x.shape[1], axis=0))
        grads["bias"] = node.sum(axis=0)
        for name, links, own in (("chain", g.chain, joint[: len(g.chain)]), ("skip", g.skip, joint[len(g.chain) :])):
            if links:
                i, j = np.array(links).T
                grads[name] = own.sum(axis=0)
                np.add.at(grads[name], (y[i], y[j]), -1)
        for name in parts:
            now = getattr(field, name)
            grad = grads[name] / len(picked) + ridge[name] * now
            scale[name] += grad**2
            now -= RATE * grad / np.sqrt(scale[name])
    return field


def training_texts(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Texts of a bounded sample of rows, chosen by a hash of their ids, so that few texts are looked at; of an id that
    repeats without end the limit takes its part."""
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))
    # Four times as many rows as are wanted, as some are long or hold nothing that could be personal data.
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, docs.count()))
    some = rows.filter(F.col("h") <= F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63)))).filter((F.length("t") <= SAMPLE_CHARS) & F.col("t").rlike("[0-9@]"))
    return [r["t"] for r in some.orderBy("h", F.xxhash64("t")).limit(SAMPLE_ROWS).collect()]


_SCHEMA = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them).

    spans are kind:start:end in code points, by kind and start, joined by commas; base_sha256 is of the base spans so
    joined. A skip-chain field, trained on made texts and on a bounded sample of rows whose base spans are rewritten in
    ways that the patterns miss, runs over every text's tokens with a digit or a sign of an address and adds the spans
    that it is sure of. Null and empty texts have no spans, an empty table gives no rows; ids are longs and null ids are
    kept; rows that repeat are all returned alike; other columns, whatever their names, are not read. Very long texts
    take time in proportion.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(training_texts(docs, id_col, text_col)))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                rows = []
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1)):
                    text = t.as_py()
                    if not text or not _SIGNAL.search(text):
                        rows.append((i, 0, 0, 0, 0, nothing, ""))
                        continue
                    base = base_spans(text)
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                    rows.append((i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + field.value.added(text, base))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
