"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel of two words is the subsequence kernel of Lodhi et al.: shared subsequences of ORDER letters, each weighted
by DECAY to the power of the stretch it covers, normalised to 1 for equal words; an insult with letters put in between,
doubled, swapped or left out stays closer to the insult than other words are. Pairs whose skip-bigrams (gaps up to three
letters) agree in less than SCREEN of the landmark's count as 0, which spares the sum for most words; tests hold the recall
of that screen. Words are whole: one longer than LETTERS is looked at in overlapping stretches, landmarks too. Landmarks are
words that stand much oftener in toxic documents than in others, by a likelihood ratio that one of so many words reaches
by chance, or the best of them where labelled rows are too few for that; the Nyström map K_mm^-1/2 k(word, landmarks) makes
the machine linear. It is trained on the labelled documents as bags of words: each toxic bag is represented by its words
that stand out and its highest-scoring one, chosen anew in each of a few rounds, and by gapped forms of the words that stand
out (virtual examples, see `gapped`), the others by all of theirs. A text's score is a logistic curve, without negative
weights, of the margins of its two worst words, fitted on the training rows and on virtual rows that have a gapped insult
in the place of theirs, so that one insult with a letter put in reaches the score as the insult itself does.

Learning takes at most SAMPLE labelled rows of each label, the first by a hash of doc_id, a bound that does not grow
with the corpus; scoring is a map over all rows and whole texts, with a memory of scores for words in each worker. Runs
of single letters count as one word, and so do words whose every second letter is one and the same. Letters with accents
count as the letter alone, other letters by classes of code points. Nulls and empty texts get the score of a text without
any word. Without two labels to learn from, or without a word that is oftener in toxic rows, every score is 0. Equal texts
get equal scores, repeated rows too. An empty table gives no rows. Extra columns are ignored, or kept by clean().
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER, DECAY, SCREEN = 3, 0.85, 0.55
#: Labelled rows of each label to learn from, landmarks, letters of a word that are looked at together.
SAMPLE, LANDMARKS, LETTERS = 2000, 64, 24
#: The kernel is the mean of the subsequence kernel and of this power of it, which tells near words apart.
SHARP = 4
#: How many toxic rows that stay are as bad as another row that is rejected.
ALARM = 1.25
#: Words of a text whose margins are looked at.
WORST = 2
#: Words whose scores a worker remembers.
REMEMBERED = 600_000
_SIGMA = 256
_FIRST, _LAST = b"\xfe", b"\xff"
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_spaced = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){3,}(?!\S)")
_edges = re.compile(r"^[\W_]+|[\W_]+$")


def pieces(text: str) -> list[str]:
    """White-space words in lower case; letters that stand one by one make a word together."""
    text = text.lower()
    words = text.split()
    for run in _spaced.findall(text):
        words.append("".join(run.split()))
    return words


class _Table(dict):
    """Letters as numbers below 254, for str.translate: a-z 1 to 26, accents aside; others in the classes behind; other marks fall away."""

    def __init__(self, instead: dict[str, str]):
        self.instead = instead

    def __missing__(self, point: int):
        c = self.instead.get(chr(point), chr(point))
        plain = unicodedata.normalize("NFKD", c)[:1]
        self[point] = got = chr(ord(plain) - 96) if "a" <= plain <= "z" else chr(27 + point % 227) if c.isalnum() else None
        return got


_table, _numbers = _Table(_LEET), _Table({})
_digits = re.compile(r"[0-9]")


def codes(word: str) -> bytes:
    """A word's letters between marks for its two ends, which count as letters. Figures stand for letters where they are
    fewer than twice the letters; else they are a number's."""
    word = _edges.sub("", word)
    figures = len(_digits.findall(word))
    table = _table if 3 * figures < 2 * len(word) else _numbers
    letters = word.translate(table).encode("latin-1")
    return _FIRST + letters + _LAST if letters else b""


def parts(letters: bytes) -> list[bytes]:
    """The letters of a word, of a long one in overlapping stretches; without its filler where every second letter is the same."""
    if len(letters) <= LETTERS:
        inner = letters[1:-1]
        if len(inner) > 6 and inner[1::2].count(inner[1]) == len(inner) // 2:
            return [letters, _FIRST + inner[::2] + _LAST]
        return [letters]
    return [letters[a : a + LETTERS] for a in range(0, len(letters) - LETTERS // 2, LETTERS // 2)]


def gapped(letters: bytes) -> list[bytes]:
    """Forms that a word may hide in: a letter or two put in, one doubled, left out or swapped; all are made by rule."""
    word = letters[1:-1]
    n, mid = len(word), len(word) // 2
    odd = [bytes([1 + (7 * k + 9 * n + sum(word)) % 26]) for k in range(4)]
    out = [word[:mid] + odd[0] + word[mid:], word[:2] + odd[1] + word[2:], word[:mid] + odd[2] + odd[3] + word[mid:], word[:2] + word[1:]]
    if n > 4:
        out += [word[:mid] + word[mid + 1 :], word[:1] + word[2:3] + word[1:2] + word[3:]]
    return [_FIRST + x + _LAST for x in out]


def padded(words: list[bytes]) -> np.ndarray:
    wide = max([LETTERS, *map(len, words)])  # forms of a long word may be longer by a letter or two
    return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)


def skips(x: np.ndarray, columns: np.ndarray, n: int, gaps: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """(words, n): which letter pairs stand at one of these distances, in order; columns: a pair's column, n for pairs without one."""
    out = np.zeros((len(x), n + 1), np.float32)
    long = int((x > 0).sum(axis=1).max(initial=0))
    row = np.arange(len(x))[:, None]
    x = x[:, :long].astype(np.int64)
    for gap in gaps:
        if long > gap:
            a, b = x[:, :-gap], x[:, gap:]
            out[row, np.where(b > 0, columns[a * _SIGMA + b], n)] = 1
    return out[:, :n]


def subsequences(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of each row of `x` with the same row of `y` (letters, 0 behind the end), not normalised."""
    n, ls, lt = len(x), x.shape[1], y.shape[1]
    same = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)
    inner = np.ones((n, ls + 1, lt + 1), np.float64)
    for _ in range(order - 1):
        nxt = np.zeros((n, ls + 1, lt + 1))
        for i in range(1, ls + 1):
            row = np.zeros(n)
            hit = same[:, i - 1, :] * inner[:, i - 1, :lt] * decay * decay
            for j in range(1, lt + 1):
                row = decay * row + hit[:, j - 1]
                nxt[:, i, j] = row
            nxt[:, i] += decay * nxt[:, i - 1]
        inner = nxt
    return (same * inner[:, :ls, :lt]).sum(axis=(1, 2)) * decay * decay


@dataclass
class Machine:
    marks: np.ndarray = field(default_factory=lambda: np.zeros((0, LETTERS), np.uint8))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the kernel row: Nyström map and hyperplane in one
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.known: dict[str, float] = {}
        self.old: dict[str, float] = {}
        self.own = np.sqrt(np.maximum(subsequences(self.marks, self.marks), 1e-300)) if len(self.marks) else np.zeros(0)
        every = np.arange(_SIGMA * _SIGMA)
        pairs = skips(self.marks, every, len(every), (1,)) if len(self.marks) else np.zeros((0, len(every)), np.float32)
        used = np.flatnonzero(pairs.any(axis=0))
        self.columns = np.full(len(every), len(used))
        self.columns[used] = np.arange(len(used))
        self.screen = (pairs[:, used] / np.maximum(pairs.sum(axis=1, keepdims=True), 1)).T.copy()

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """(words, landmarks), normalised; 0 below the screen."""
        out = np.zeros((len(x), len(self.marks)), np.float32)
        long = (x > 0).sum(axis=1)
        spans = (self.marks > 0).sum(axis=1)
        for at in range(0, len(x), 20_000):
            part, size = x[at : at + 20_000], long[at : at + 20_000]
            i, j = np.nonzero(skips(part, self.columns, len(self.screen)) @ self.screen >= SCREEN)
            if not len(i):
                continue
            some = np.unique(i)
            own = np.ones(len(part))
            for k in np.array_split(some[np.argsort(size[some], kind="stable")], -(-len(some) // 2000)):
                s = part[k][:, : size[k].max()]
                own[k] = np.sqrt(np.maximum(subsequences(s, s), 1e-300))
            order = np.argsort(size[i], kind="stable")  # words of one length side by side: no sums over empty places
            i, j = i[order], j[order]
            for k in range(0, len(i), 2000):
                a, b = i[k : k + 2000], j[k : k + 2000]
                s, t = part[a][:, : size[a].max()], self.marks[b][:, : spans[b].max()]
                alike = subsequences(s, t) / (own[a] * self.own[b])
                out[at + a, b] = (alike + alike**SHARP) / 2
        return out

    def words(self, some: list[str]) -> np.ndarray:
        """The margin of each word: of its nearest stretch to each landmark. Words of the same letters are looked at once."""
        spelt = [codes(w) for w in some]
        different = {x: k for k, x in enumerate(dict.fromkeys(spelt))}
        best = self.margins(list(different))
        return best[[different[x] for x in spelt]]

    def margins(self, spelt: list[bytes]) -> np.ndarray:
        cut = [parts(x) for x in spelt]
        flat = [p for c in cut for p in c]
        if not flat:
            return np.zeros(0)
        got = np.maximum.reduceat(self.kernel(padded(flat)), np.cumsum([0, *map(len, cut)])[:-1])
        return got @ self.weight + self.bias

    def remember(self, some: set[str]) -> None:
        """Put the scores of `some` into `known`: from the generation before, else anew."""
        if len(self.known) > REMEMBERED // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for w in some:
            if w not in known:
                x = old.get(w)
                if x is None:
                    new.append(w)
                else:
                    known[w] = x
        floor = float(self.bias)  # one object for all words below the screen
        known.update((w, floor if x == floor else x) for w, x in zip(new, self.words(new).tolist()))

    def features(self, words: set[str]) -> list[float]:
        """The margins of the worst words, from the worst on, between -1 and 2."""
        floor = float(self.bias)
        found = sorted(x for x in map(self.known.__getitem__, words) if x > floor)[-WORST:]
        return worst(found, floor)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.curve):
            return np.zeros(len(texts))
        out = []
        for at in range(0, len(texts), 500):
            bags = [set(pieces(t)) for t in texts[at : at + 500]]
            self.remember(set().union(*bags))
            out.extend(map(self.features, bags))
        x = np.array(out).reshape(-1, WORST)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def worst(found: list[float], floor: float) -> list[float]:
    """`found`: margins above `floor`, the greatest last."""
    return [min(2.0, max(-1.0, x)) for x in [*found[::-1], *[floor] * WORST][:WORST]]


def hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None, l2: float = 1e-4, steps: int = 500) -> np.ndarray:
    """A linear support vector machine (squared hinge) by accelerated gradient steps: weights, and the constant behind them."""
    n = cost.sum()
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = v = np.zeros(z.shape[1]) if start is None else start
    lip = 2 * np.linalg.eigvalsh((z * cost[:, None].astype(np.float32)).T.astype(float) @ z / n)[-1] + l2
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v.astype(np.float32)))
        grad = -2 * ((cost * y * slack).astype(np.float32) @ z) / n + l2 * np.append(v[:-1], 0)
        new = v - grad / lip
        v, w = new + t / (t + 3) * (new - w), new
    return w


def logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of the columns and of a constant; columns that would count against are left out, so scores never fall as words get worse."""
    z = np.hstack([x, np.ones((len(x), 1))])
    use = np.ones(z.shape[1], bool)
    while True:
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (cost * p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(w))
            step = np.zeros(len(w))
            step[use] = np.linalg.solve(h[np.ix_(use, use)], ((cost * (y - p)) @ z - l2 * w)[use])
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            return w
        use[int(np.argmin(w[:-1]))] = False


def first_of_kind(texts: list[str], like: float = 0.8) -> np.ndarray:
    """Places of the texts that aren't near copies of one before: copies would make all their words stand out. Pairs that
    agree in a band of least hashes are compared word set by word set, as sorted hashes of the words."""
    seen: dict[tuple, np.ndarray] = {}
    out = []
    for k, t in enumerate(texts):
        raw = [w.encode("utf-8", "surrogatepass") for w in set(t.lower().split())]
        hashes = [np.array([xxhash.xxh64_intdigest(w, seed) for w in raw], np.uint64) for seed in range(4)]
        least = [int(h.min(initial=np.iinfo(np.uint64).max)) for h in hashes]
        words = np.sort(hashes[0])
        bands = [(0, least[0], least[1]), (1, least[2], least[3])]
        both = [np.isin(words, seen[b], assume_unique=True).sum() / max(1, len(words) + len(seen[b])) for b in bands if b in seen]
        if not any(x / max(1e-9, 1 - x) >= like for x in both):
            out.append(k)
        for b in bands:
            seen.setdefault(b, words)
    return np.array(out, np.int64)


def stands_out(words: int) -> float:
    """The likelihood ratio (chi-square, one degree) that about one of so many words reaches by chance."""
    return NormalDist().inv_cdf(1 - 0.5 / max(2, words)) ** 2


def fit(texts: list[str], toxic: np.ndarray, prior: np.ndarray, marks: int = LANDMARKS, rounds: int = 4) -> Machine:
    """`prior`: the weight of each row, so that both labels have the share they have among all labelled rows."""
    if toxic.all() or not toxic.any():
        return Machine()
    alone = first_of_kind(texts)
    texts, toxic, prior = [texts[k] for k in alone], toxic[alone], prior[alone]
    if toxic.all() or not toxic.any():
        return Machine()
    bags = [sorted({sys.intern(w) for w in pieces(t)}) for t in texts]  # a word once, however many bags hold it
    spell = {w: codes(w) for b in bags for w in b}
    seen = [Counter(), Counter()]
    for b, y in zip(bags, toxic):
        seen[int(y)].update({spell[w] for w in b if len(spell[w]) > 4})
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    ratios = {}
    for s, c in seen[1].items():  # the likelihood ratio of its counts, where it is much the oftener in toxic rows
        d, p = seen[0][s], n1 / (n1 + n0)
        ratio = 2 * (c * np.log(c / ((c + d) * p)) + (d * np.log(d / ((c + d) * (1 - p))) if d else 0.0))
        if c / n1 > 5 * d / n0:
            ratios[s] = ratio
    least = stands_out(len(seen[1]))  # every word of toxic rows has been looked at
    if ratios and max(ratios.values()) <= least:  # too few rows for any word to stand out: the best are taken as they are
        least = 0.999 * max(ratios.values())
    excess = {s: ratio for s, ratio in ratios.items() if ratio > least}
    ranked = sorted(excess, key=lambda s: (-excess[s], s))
    chosen: list[bytes] = []
    for letters in [p for w in ranked for p in parts(w)]:  # the strongest words, or stretches of long ones, that are not all but one with a chosen one
        if len(letters) < ORDER:
            continue
        x = padded([letters])
        if chosen:
            y = padded(chosen)
            near = subsequences(np.repeat(x, len(y), 0), y) / np.sqrt(subsequences(x, x)[0] * subsequences(y, y) + 1e-300)
            if near.max() > 0.85:
                continue
        chosen.append(letters)
        if len(chosen) == marks:
            break
    if not chosen:
        return Machine()
    machine = Machine(marks=padded(chosen), weight=np.zeros(len(chosen)))
    # words of other rows that are close to a landmark become landmarks too: what tells them apart has to be in the map
    near = [w for w, c in seen[0].most_common() if c > 1 and len(w) <= LETTERS and w not in excess]
    close: list[tuple[float, bytes]] = []
    for at in range(0, len(near), 20_000):
        some = near[at : at + 20_000]
        best = machine.kernel(padded(some)).max(axis=1)
        close += [(seen[0][some[k]], some[k]) for k in np.flatnonzero(best >= 0.4)]
    chosen += [w for _, w in sorted(close, key=lambda x: (-x[0], x[1]))[: marks // 2]]
    machine = Machine(marks=padded(chosen), weight=np.zeros(len(chosen)))
    k = machine.kernel(machine.marks)
    k = (k + k.T) / 2
    values, vectors = np.linalg.eigh((k + 1e-6 * np.eye(len(k))).astype(np.float64))
    root = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)
    vocabulary = sorted({w for b in bags for w in b})
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = [np.array([number[w] for w in b], np.int64) for b in bags]
    sign = np.array([excess.get(spell[w], 0.0) for w in vocabulary])
    # words below the screen are one and the same point, the origin: only the others' rows are kept, row 0 stands for the rest
    place, kept = np.zeros(len(vocabulary), np.int64), [np.zeros((1, len(chosen)), np.float32)]
    for at in range(0, len(vocabulary), 20_000):
        cut = [parts(spell[w]) for w in vocabulary[at : at + 20_000]]
        k = machine.kernel(padded([p for c in cut for p in c]))
        k = np.maximum.reduceat(k, np.cumsum([0, *map(len, cut)])[:-1])
        some = np.flatnonzero(k.any(axis=1))
        place[at + some] = sum(map(len, kept)) + np.arange(len(some))
        kept.append(k[some])
    raw = np.concatenate(kept) @ root
    score = sign.copy()
    background = Counter(int(i) for r, y in zip(rows, toxic) if not y for i in r)
    common_words = np.array(sorted(i for i in background if place[i]), np.int64)
    worth = np.array([*[background[i] for i in common_words.tolist()], sum(c for i, c in background.items() if not place[i])], float)
    forms = {w: gapped(spell[w]) for w in sorted({spell_of for spell_of in vocabulary if excess.get(spell[spell_of], 0.0) > 0}) if len(spell[w]) <= LETTERS}
    flat = [f for some in forms.values() for f in some]
    virtual = machine.kernel(padded(flat)) @ root if flat else np.zeros((0, len(chosen)))
    owner = [number[w] for w, some in forms.items() for _ in some]
    where, plane = np.concatenate((common_words, [-1])), None
    for turn in range(rounds):
        witness, against = Counter(), Counter()
        for r, y in zip(rows, toxic):
            if not len(r):
                continue
            best = int(r[np.argmax(score[r])])
            if y:
                witness.update({int(i) for i in r[sign[r] > 0]} | ({best} if turn else set()))
            elif turn:
                against[best if place[best] else -1] += 1
        mine = np.array(sorted(witness), np.int64)
        if not len(mine):
            return Machine()
        x = np.vstack([raw[place[mine]], virtual, raw[place[common_words]], raw[:1]])
        y = np.concatenate((np.ones(len(mine) + len(virtual)), -np.ones(len(worth))))
        often = np.array([*[witness[i] for i in mine.tolist()], *[witness[i] / len(forms[vocabulary[i]]) for i in owner]], float)
        other = worth * often.sum() / worth.sum()
        if turn:  # besides, the worst word of each other row counts as one, as a toxic row's words do
            other = other + np.array([against[i] for i in where.tolist()], float)
        cost = np.concatenate((often, other))
        plane = hinge(x, y, cost, plane)
        w, bias = plane[:-1], float(plane[-1])
        score = (raw @ w + bias)[place]
    machine = Machine(marks=machine.marks, weight=root @ w, bias=bias)
    machine.known = dict(zip(vocabulary, score.tolist()))
    x = [machine.features(set(b)) for b in bags]
    y, cost = toxic.astype(float), prior.copy()
    # a virtual row for each form: a toxic row with that form in the place of the words that stand out, half as much as the row itself in all
    shown = dict(zip(range(len(virtual)), (virtual @ w + bias).tolist()))
    of = {v: [k for k, o in enumerate(owner) if o == v] for v in set(owner)}
    more, weights = [], []
    for k in np.flatnonzero(toxic).tolist():
        hidden = [j for i in rows[k][sign[rows[k]] > 0].tolist() for j in of.get(i, ())]
        if not hidden:
            continue
        rest = sorted(v for v in score[rows[k]][sign[rows[k]] <= 0].tolist() if v > bias)
        for j in hidden:
            more.append(worst(sorted([*rest[-WORST:], shown[j]])[-WORST:], float(bias)))
            weights.append(cost[k] / (2 * len(hidden)))
    x, y, cost = np.array([*x, *more]), np.concatenate((y, np.ones(len(more)))), np.concatenate((cost, weights))
    machine.curve = curve(x, y, cost)
    machine.known = {}
    return machine


def curve(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The logistic curve, moved so that 0.5 stands where the fewest rows, by weight, are on the wrong side, in the middle of the gap there."""
    w = logistic(x, y, cost)
    if not w[:-1].any():
        return w
    z = x @ w[:-1]
    order = np.argsort(z, kind="stable")
    z, y, cost = z[order], y[order], (cost * np.where(y > 0, 1.0, ALARM))[order]
    wrong = np.concatenate(([(cost * (1 - y)).sum()], (cost * (1 - y)).sum() + np.cumsum(cost * np.where(y > 0, 1, -1))))  # with the first k below
    open_ = np.concatenate(([True], z[1:] > z[:-1], [True]))
    k = int(np.flatnonzero(open_)[np.argmin(wrong[open_])])
    low, high = z[max(0, k - 1)], z[min(k, len(z) - 1)]
    w[-1] = -(low + high) / 2
    return w


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from the labelled rows outside the held-out fifth."""
    common.small_batches(df.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):  # a top-k by hash for each label: no full sort, and what comes back is bounded
        part = marked.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.join(F.broadcast(chosen), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, toxic = got.column("text").to_pylist(), got.column("toxic").to_numpy().astype(bool)
    if not len(texts):
        return Machine()
    share = [counts.get(y, 0) / max(1, int((toxic == bool(y)).sum())) for y in (0, 1)]
    prior = np.where(toxic, share[1], share[0])
    return fit(texts, toxic, prior / prior.mean())


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def score(df: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def judge(batches):
        for batch in batches:
            s = machine.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = common.plain(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(judge, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def clean(df: DataFrame, machine: Machine) -> DataFrame:
    """The rows of `df`, all columns, that aren't predicted toxic."""
    common.small_batches(df.sparkSession)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(machine.scores([t or "" for t in batch.column("text").to_pylist()]) < 0.5))

    return df.mapInArrow(keep, df.schema)
