"""A linear-chain conditional random field over word-shape features, in numpy.

Sentences are lists of tokens. Training is by full-batch gradient steps on the conditional
log-likelihood with a quadratic penalty; decoding is Viterbi over padded batches.
"""

from __future__ import annotations

import re

import numpy as np

LABELS = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone")
_CLASSES = {**dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x"), **dict.fromkeys("0123456789", "d")}
_TABLE = str.maketrans(_CLASSES)
_RUNS = re.compile(r"(.)\1+", re.DOTALL)
EDGE = ".,;:!?\"'[]<>"


def shape(token: str) -> str:
    """Letters as X and x, digits as d, letters past ASCII as x, the rest as it is."""
    s = token.strip(EDGE).translate(_TABLE)
    return s if s.isascii() else "".join("x" if c.isalpha() else c for c in s)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def own_features(token: str) -> tuple[str, ...]:
    """The features of a token by itself. A token without digit, @ and + has only its kind of word."""
    s = shape(token)
    digits = s.count("d")
    if not digits and "@" not in s and "+" not in s:
        return ("word",)
    short = _RUNS.sub(r"\1", s)
    marks = "".join(sorted({c for c in s if c not in "Xxd"}))
    letters = "x" in s or "X" in s
    size = next((b for b in (0, 1, 2, 3, 4, 6, 8, 11, 15, 16, 19) if digits <= b), 99)
    at = s.partition("@")
    found = [f"short={short}", f"digits={size}", f"marks={marks}", f"letters={letters}", f"dots={min(s.count('.'), 4)}"]
    if not letters:
        found.append(f"full={s}")
    if 12 <= digits <= 19 and not letters:
        found.append(f"luhn={luhn(re.sub('[^0-9]', '', token))}")
    if at[1]:
        found.append(f"at={bool(at[0])},{'.' in at[2]}")
    return tuple(found)


def near_features(token: str) -> tuple[str, ...]:
    """What a neighbour sees of a token."""
    own = own_features(token)
    return own[:1] if own == ("word",) else own[1:4]


def features(tokens: list[str]) -> list[list[str]]:
    own, near = [own_features(t) for t in tokens], [near_features(t) for t in tokens]
    edge = ("edge",)
    return [
        ["bias", *own[i], *("<" + f for f in (near[i - 1] if i else edge)), *(">" + f for f in (near[i + 1] if i + 1 < len(tokens) else edge))]
        for i in range(len(tokens))
    ]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Crf:
    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.names, self.weights, self.moves, self.starts = names, weights, moves, starts
        plain = [[names[f] for f in x if f in names] for x in features(["word"] * 3)]
        # all-O is the best path over plain words if no step does better than O after O
        self.plain_is_outside = all(
            (s := weights[x].sum(axis=0))[0] >= s.max() and (moves + s)[0, 0] >= (moves + s).max() and (starts + s)[0] >= (starts + s).max() for x in plain
        )

    @classmethod
    def train(cls, sentences: list[tuple[list[str], list[str]]], steps: int = 100, penalty: float = 0.02, rate: float = 0.15) -> Crf:
        rows = [features(tokens) for tokens, _ in sentences]
        names = {f: i for i, f in enumerate(sorted({f for r in rows for x in r for f in x}))}
        n, t, k = len(rows), max(map(len, rows)), max(len(x) for r in rows for x in r)
        none = len(names)
        ids, gold, mask = np.full((n, t, k), none), np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (r, (_, labels)) in enumerate(zip(rows, sentences, strict=True)):
            for j, x in enumerate(r):
                ids[i, j, : len(x)] = [names[f] for f in x]
                gold[i, j], mask[i, j] = LABELS.index(labels[j]), True
        size = len(LABELS)
        parts = [np.zeros((none + 1, size)), np.zeros((size, size)), np.zeros(size)]
        sums = [np.zeros_like(p) for p in parts]
        eye = np.eye(size)
        seen = [np.zeros_like(p) for p in parts]
        np.add.at(seen[0], ids[mask], eye[gold[mask]][:, None, :])
        both = mask[:, 1:] & mask[:, :-1]
        np.add.at(seen[1], (gold[:, :-1][both], gold[:, 1:][both]), 1)
        seen[2] += eye[gold[:, 0]].sum(axis=0)
        for _ in range(steps):
            w, moves, starts = parts
            emit = w[ids].sum(axis=2)
            ahead, back = np.zeros((n, t, size)), np.zeros((n, t, size))
            ahead[:, 0] = starts + emit[:, 0]
            for j in range(1, t):
                step = _log_sum(ahead[:, j - 1, :, None] + moves, 1) + emit[:, j]
                ahead[:, j] = np.where(mask[:, j, None], step, ahead[:, j - 1])
            total = _log_sum(ahead[:, -1], 1)
            for j in range(t - 2, -1, -1):
                step = _log_sum(moves + (emit[:, j + 1] + back[:, j + 1])[:, None, :], 2)
                back[:, j] = np.where(mask[:, j + 1, None], step, 0.0)
            one = np.exp(ahead + back - total[:, None, None])
            hoped = [np.zeros_like(p) for p in parts]
            np.add.at(hoped[0], ids[mask], one[mask][:, None, :])
            pairs = np.exp(ahead[:, :-1, :, None] + moves + (emit + back)[:, 1:, None, :] - total[:, None, None, None])
            hoped[1] = pairs[both].sum(axis=0)
            hoped[2] = one[:, 0].sum(axis=0)
            for p, s, h, g in zip(parts, sums, hoped, seen, strict=True):
                slope = g - h - penalty * p
                s += slope * slope
                p += rate * slope / np.sqrt(s + 1e-8)
            parts[0][none] = 0
        return cls(names, *parts)

    def emissions(self, tokens: list[str], known: dict) -> np.ndarray:
        """known: caches, by token, the sums of the weights of its own, left and right features."""
        def parts(token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if (got := known.get(token)) is None:
                at = lambda fs, sign: self.weights[[self.names[sign + f] for f in fs if sign + f in self.names]].sum(axis=0)
                got = (at(("bias", *own_features(token)), ""), at(near_features(token), "<"), at(near_features(token), ">"))
                if len(known) < 200_000:
                    known[token] = got
            return got

        edge = [self.weights[self.names[s]] for s in ("<edge", ">edge")]
        ps = [parts(t) for t in tokens]
        own = np.array([p[0] for p in ps])
        own[0] += edge[0]
        own[-1] += edge[1]
        if len(ps) > 1:
            own[1:] += np.array([p[1] for p in ps[:-1]])
            own[:-1] += np.array([p[2] for p in ps[1:]])
        return own

    def decode(self, emissions: list[np.ndarray], cells: int = 400_000) -> list[list[str]]:
        """The best labels of each sentence; sentences of like length go through Viterbi together."""
        out: list[list[str]] = [[] for _ in emissions]
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        while order:
            longest = len(emissions[order[-1]])
            group = order[-max(1, cells // longest) :]
            del order[-len(group) :]
            lengths = np.array([len(emissions[i]) for i in group])
            emit = np.zeros((longest, len(group), len(LABELS)))
            for j, i in enumerate(group):
                emit[: lengths[j], j] = emissions[i]
            best = self.starts + emit[0]
            came = np.zeros((longest, len(group), len(LABELS)), np.int8)
            for t in range(1, longest):
                ways = best[:, :, None] + self.moves
                came[t] = ways.argmax(axis=1)
                step = ways.max(axis=1) + emit[t]
                best = np.where((t < lengths)[:, None], step, best)
            at = best.argmax(axis=1)
            path = np.zeros((longest, len(group)), np.int8)
            for t in range(longest - 1, -1, -1):
                path[t] = at
                at = np.where((t < lengths) & (t > 0), came[t, np.arange(len(group)), at], at)
            for j, i in enumerate(group):
                out[i] = [LABELS[k] for k in path[: lengths[j], j]]
        return out


#: Written for training: tokens parted by spaces, fields in braces. Numbers in running text, orders, versions, dates, prices,
#: keys and card-like runs that fail their check digit stand as negatives beside what is to be found.
TEMPLATES = """
write to {email} before {date}
please contact {email} or call {phone} for details
mail : {email} , phone {phone} , room {small}
{email} {email}
cc {email} on all invoices above {price}
the host {ip} answered in {small} ms
connect from {ip} to {ip} port {port}
deny {ip} and allow version {version}
server at {ip} is down since {time}
release {version} of the tool fixes issue {hash}
section {version} of the manual , page {small}
call us at {phone} or {phone} today
telephone {phone} ext {small}
{phone} {ip}
{phone} {email}
{ip} {phone} {card}
the office ( {phone} ) opens at {time}
paid with card {card} on {date}
card number {card} expires {month}
{card} {card}
{card} {email} {ip}
number {card} was charged {price}
order {badcard} was shipped on {date}
order {order} total {price} items {small}
the serial {badcard} is printed on the back
la referencia {badcard} no es una tarjeta
und die nummer {badcard} ist eine kennung
tracking {order} and invoice {order}
{badcard} {badcard}
{badcard} {ip}
token {hex} expires in {small} days
id {hex} and {hex} were merged
in {year} about {big} people lived in {small} towns
between {year} and {year} prices rose by {percent}
table {small} lists {small} rows and {small} columns
le prix est de {price} pour {small} articles
am {date} um {time} kamen {big} leute
el {date} a las {time} en la sala {small}
score {small} to {small} after {small} minutes
license version {version} clause {small}
isbn {isbn} printed in {year}
c++{small} and a{small} b{small} are names
see @{name} and #{small} for more
+{small} points , -{small} points , {small}+{small}
coordinates {decimal} and {decimal} at {small} m
room {small}-{small} building {small}
a plain line of words with no number
"""


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _field(rng: np.random.Generator, name: str) -> tuple[list[str], str]:
    """Tokens of a field, and their kind or nothing."""
    pick = lambda *x: x[rng.integers(0, len(x))]
    d = lambda n: _number(rng, n)
    small = lambda: str(rng.integers(1, 10 ** rng.integers(1, 4)))
    if name == "email":
        who = pick("ann", "jo.doe", "x_y", "k2", "m-l", "re.info") + pick("", d(1), d(2), "." + d(2))
        return [pick("", "", "", "<", "(") + who + "@" + pick("mail", "site-a", "web" + d(1), "mx") + pick(".org", ".com", ".example.com", ".co.uk", ".de") + pick("", "", "", ".", ",", ";")], name
    if name == "ip":
        return [".".join(str(rng.integers(0, 256)) for _ in range(4)) + pick("", "", "", ".", ",")], name
    if name in ("card", "badcard"):
        n = 16 if rng.random() < 0.85 else int(rng.integers(13, 20))
        digits = d(n - 1)
        last = next(c for c in "0123456789" if luhn(digits + c))
        if name == "badcard":
            last = str((int(last) + rng.integers(1, 10)) % 10)
        digits += last
        parts = [digits[i : i + 4] for i in range(0, n, 4)]
        tokens = pick([digits], [digits], [digits], ["-".join(parts)], parts if n == 16 and name == "card" else [digits])
        return [*tokens[:-1], tokens[-1] + pick("", "", "", ".", ",", "%%", "***")], "card" if name == "card" else ""
    if name == "phone":
        a, b, c = d(3), d(3), d(4)
        shapes = [["+" + d(1), f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], ["+" + d(2), a, b, c], ["+" + d(11)], [f"+{d(1)}-{a}-{b}-{c}"], [f"({a}){b}-{c}"], ["+" + d(1), f"{a}.{b}.{c}"]]
        tokens = shapes[rng.integers(0, len(shapes))]
        return [*tokens[:-1], tokens[-1] + pick("", "", "", ".", ",")], name
    plain = {
        "small": small, "port": lambda: d(4), "big": lambda: pick(d(5), d(6), d(2) + "," + d(3), d(1) + "." + d(3) + "." + d(3)), "year": lambda: pick("19", "20") + d(2),
        "date": lambda: pick("20" + d(2) + "-0" + d(1) + "-1" + d(1), d(2) + "/" + d(2) + "/20" + d(2), d(1) + "." + d(1) + ".20" + d(2), "20" + d(6)), "time": lambda: d(2) + ":" + d(2),
        "month": lambda: d(2) + "/" + d(2), "price": lambda: pick("$", "") + small() + "." + d(2), "percent": lambda: small() + "%", "hash": lambda: "#" + small(),
        "version": lambda: pick("", "v") + ".".join(small() for _ in range(rng.integers(1, 4))), "order": lambda: pick(d(7), d(8), d(9), d(10), d(12) + d(12), d(3) + "-" + d(7) + "-" + d(7), "A" + d(9)),
        "hex": lambda: "".join(rng.choice(list("0123456789abcdef"), rng.integers(16, 41))), "isbn": lambda: "978-" + d(1) + "-" + d(5) + "-" + d(3) + "-" + d(1), "decimal": lambda: pick("", "-", "+") + d(2) + "." + d(6),
        "name": lambda: "".join(rng.choice(list("abcdefghij"), 5)),
    }
    return [plain[name]() + pick("", "", "", "", ",", ".")], ""


def labelled_table(n: int = 600, seed: int = 9) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: the templates in turn with fields filled at random, between words and digits of no meaning."""
    rng = np.random.default_rng(seed)
    lines = [t.split() for t in TEMPLATES.strip().split("\n")]
    rows = []
    for i in range(n):
        tokens, labels = [], []
        for part in lines[i % len(lines)]:
            if m := re.fullmatch(r"(.*)\{(\w+)\}(.*)", part) if part.count("{") == 1 else None:
                found, kind = _field(rng, m[2])
                found = [m[1] + found[0], *found[1:]] if kind == "" else found
                found[-1] += m[3]
            else:
                found, kind = [re.sub(r"\{\w+\}", lambda _: _number(rng, 2), part)], ""
            tokens += found
            labels += [f"{'BI'[j > 0]}-{kind}" if kind else "O" for j in range(len(found))]
        rows.append((tokens, labels))
    return rows
