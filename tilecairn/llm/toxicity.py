"""Toxicity scores after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.llm.common import Scratch, full_text, modest_batches, small_batches

# Letters that a character may stand for, in the order of how common that is.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s"}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœ"
#: A masked letter may be any of these.
MASKS, MASKED = "*#", "abcdefghijklmnopqrstuvwxyz"
#: Marks that may stand between the letters of a word.
BETWEEN = ".-_*~"
#: Costs of the channel, in nats: a letter for itself, for another character, for a mask, one of a run of three or
#: more, the second of two, a border of words where none is written.
PLAIN, STANDS, MASK, SQUEEZE, DOUBLE, BORDER = 0.0, 1.0, 1.5, 0.5, 3.0, 0.0

_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1
_CODES = np.zeros(0x2100, np.int64)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _CODES[ord(_c.upper())] = _i

EDGE = " \t\n\r\x0b\x0c.,;:?!\"'()[]{}<>&%#*$|=/\\~^`+-_@"
TAIL = " \t\n\r\x0b\x0c.,;:?!\"')]}>&%#*$|=/\\~^`+-_"
HEAD = " \t\n\r\x0b\x0c.,;:?\"'([{<&%#*=/\\~^`+-_"
#: Runs of three or more single characters with single spaces between them.
SPACED = re.compile(r"(?<!\S)(?:[^\s] ){2,}[^\s](?!\S)")
#: Marks that may join words.
MARKS = re.compile(r"[.\-_*~,;:/\\|]+")
LONG_RUN, REPEATED = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
ODD = re.compile(r"[^\W\d_][^\W_]*[0-9@$!|+(<{€£¡§*#.\-_~][^\W_]|[0-9@$!|+(<{€£¡§][^\W\d_]|[^\W_][*#]+[^\W_]")


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of three characters in a row over the letters, all others being one border."""
    points = np.frombuffer("  ".join(texts).encode("utf-32-le", "replace"), np.uint32)
    code = _CODES[np.minimum(points, 0x20FF)]
    if len(code) < 3:
        return np.zeros(SIZE**3, np.int64)
    return np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)


@dataclass
class Letters:
    """A character language model: the cost in nats of a letter after two others."""

    cost: np.ndarray

    @cached_property
    def flat(self) -> list[float]:
        """The costs by (first * SIZE + second) * SIZE + third, as a list, which single look-ups are faster in."""
        return self.cost.ravel().tolist()

    @classmethod
    def of(cls, counts: np.ndarray) -> Letters:
        c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two = c.sum(0)
        one = two.sum(0)
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
        return cls(-np.log((c + 4 * p2) / (c.sum(2, keepdims=True) + 4)))


def lattice(token: str, run: bool = False) -> list[list[tuple[str, float]]]:
    """For each place of a token what it may stand for ("" for nothing, a space for a border of words) and the costs:
    leetspeak, masks, marks between letters, a single one also between words, and runs, of which all but the first may be noise. In a
    run of single characters, which were written with spaces, any of them may begin a word."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(token):
        repeated = i > 0 and token[i - 1] == c
        noise = SQUEEZE if repeated and (token[i - 2 : i - 1] == c or token[i + 1 : i + 2] == c) else DOUBLE
        if c in _INDEX:
            choice = [(c, PLAIN)]
        elif c in LEET:
            choice = [(x, STANDS + 0.3 * k) for k, x in enumerate(LEET[c])]
            if not i and not c.isalnum():
                choice.append(("", STANDS))  # a mark before the word
        elif c in MASKS:
            choice = [(x, MASK) for x in MASKED]
        else:
            choice, repeated = [], False
        if run and i:
            choice += [(" " + x, cost + BORDER) for x, cost in choice]
        if repeated and c not in MASKS:
            choice.append(("", noise))
        if c in MASKS or c in BETWEEN:
            choice.append(("", STANDS))
        if c in BETWEEN and c not in (token[i - 1 : i], token[i + 1 : i + 2]):
            choice.append((" ", STANDS + BORDER))
        out.append(choice or [("", 2 * MASK)])
    return out


#: Characters of a token that are decoded at a time.
PIECE = 64


def viterbi(token: str, letters: Letters, run: bool = False) -> str:
    """The likeliest letters behind a token, with spaces where words begin. One of more than PIECE characters is
    decoded piece by piece, each after the two letters that the one before ends with, so the work is linear."""
    border = 0
    choices, state, out = lattice(token, run), (border, border), []
    known: dict = {}
    for at in range(0, max(len(token), 1), PIECE):
        last = at + PIECE >= len(token)
        key = (token[max(at - 2, 0) : at + PIECE + 1], min(at, 2), state, last)
        if key not in known:
            known[key] = _decoded(choices[at : at + PIECE], letters, state, last)
        text, state = known[key]
        out.append(text)
    return "".join(out)


def _decoded(choices: list, letters: Letters, state: tuple[int, int], last: bool) -> tuple[str, tuple[int, int]]:
    """The likeliest letters of these places after two letters, and the two letters then; last: a border follows."""
    flat, index = letters.flat, _INDEX
    best: dict[int, tuple[float, str]] = {state[0] * SIZE + state[1]: (0.0, "")}
    for choice in choices:
        now: dict[int, tuple[float, str]] = {}
        for state_, (cost, text) in best.items():
            for x, extra in choice:
                at, total = state_, cost + extra
                for c in x:
                    i = index.get(c, 0)  # a space is a border
                    total += flat[at * SIZE + i]
                    at = at % SIZE * SIZE + i
                value = (total, text + x)
                if at not in now or value < now[at]:
                    now[at] = value
        best = now
    _, text, at = min((cost + (flat[at * SIZE] if last else 0.0), text, at) for at, (cost, text) in best.items())
    return text, divmod(at, SIZE)


def spelled(token: str, trie: dict) -> str | None:
    """A start in the lexicon, of the least cost, that the lattice of a token can spell from its first place."""
    best: tuple[float, str] | None = None
    states = {"": (0.0, trie)}
    for choice in lattice(token):
        now: dict[str, tuple[float, dict]] = {}
        for text, (cost, node) in states.items():
            for x, extra in choice:
                if x == " ":
                    continue
                after = node if not x else node.get(x)
                if after is None:
                    continue
                value = cost + extra
                if text + x not in now or value < now[text + x][0]:
                    now[text + x] = (value, after)
                if x and "" in after and (best is None or value < best[0]):
                    best = (value, text + x)
        states = now
        if not states:
            break
    return best and best[1]


def inner(token: str, trie: dict) -> list[str]:
    """Starts in the lexicon that the lattice of a token can spell from its second place or a later one: of a
    place the longest of the least cost, each after the end of the one before."""
    found, states = [], {}
    for n, choice in enumerate(lattice(token.rstrip(TAIL).lstrip(HEAD))):
        if n:
            states[""] = (0.0, n, trie)
        now: dict[str, tuple[float, int, dict]] = {}
        for text, (cost, first, node) in states.items():
            for x, extra in choice:
                if x == " ":
                    continue
                after = node if not x else node.get(x)
                if after is None or not text + x:
                    continue
                value = cost + extra
                if text + x not in now or value < now[text + x][0]:
                    now[text + x] = (value, first, after)
                if x and "" in after:
                    found.append((first, value, -len(text + x), n + 1, text + x))
        states = now
    out, at = [], 0
    for first, _, _, end, text in sorted(found):
        if first >= at:
            out.append(text)
            at = end
    return out


def parts(token: str) -> list[tuple[str, bool]]:
    """What stands between the marks of a token, and whether it is a run of single characters, which are
    taken together, as they are of a token with spaces."""
    if " " in token:
        return [(token.replace(" ", ""), True)]
    out: list[tuple[str, bool]] = []
    for x in MARKS.split(token):
        if len(x) == 1 and out and out[-1][1]:
            out[-1] = (out[-1][0] + x, True)
        elif x:
            out.append((x, len(x) == 1))
    return out


#: Tokens whose features a worker keeps, and as many of those before.
KNOWN = 120_000
#: Tokens whose features a worker keeps while the model is fitted.
FITTED = 60_000
#: Starts of words that are features, by letters, and counts of a feature in a text that are features too.
STARTS, COUNTS = (4, 5, 6, 7), (2, 4)


@dataclass
class Model:
    """The letters' model and a logistic model of a text's features. A feature is a whole word (with a space at
    its end), a start of a word, or either with "#n": found n times at least. ``sure`` holds features by
    which alone a text is taken to be toxic, with the probability."""

    letters: Letters
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    sure: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        total: Counter = Counter()
        for f, w in self.weights.items():
            total[f.split("#")[0]] += w
        self.used = frozenset(total)
        self.trie: dict = {}
        for word in [f for f, w in total.items() if w > 0.5]:
            node = self.trie
            for c in word.rstrip(" "):
                node = node.setdefault(c, {})
            node[""] = True
        self.known: dict[str, tuple[str, ...]] = {}
        self.before: dict[str, tuple[str, ...]] = {}

    def restored(self, token: str, run: bool = False) -> str:
        """The words behind a token by viterbi(): as it stands, if it has but letters of which none is doubled, which is
        all that its lattice has then, or has no letter. run: it is a run of single characters."""
        odd = token.rstrip(TAIL).lstrip(HEAD)
        if odd.isalpha() and not run and not REPEATED.search(odd):
            return odd
        if not any(c in _INDEX for c in odd):
            return token.strip(EDGE)
        return viterbi(odd, self.letters, run)

    def features(self, token: str) -> tuple[str, ...]:
        """Of a lower-case token: the words behind it and their starts, also of what stands between its marks. Beside
        what was decoded, starts in the lexicon that the lattice can spell count too."""
        glued = " " in token
        letters = token.replace(" ", "")
        out = self.decoded_features(letters, glued)
        if not glued and not MARKS.search(token):
            return tuple(out)
        found = parts(token)
        for k, (part, run) in enumerate(found):
            if len(found) > 1:
                more = self.decoded_features(part, run)
                out += more if k else [f for f in more if f not in out]
            if run and self.trie:
                out += [f for word in inner(part, self.trie) for f in self.word_features(word) if f not in out]
        return tuple(out)

    def decoded_features(self, token: str, run: bool) -> list[str]:
        words = self.restored(token, run).split(" ")
        out = [f for w in words for f in self.word_features(w)]
        odd = token.rstrip(TAIL).lstrip(HEAD)
        if self.trie and (LONG_RUN.search(odd) or ODD.search(odd)):
            start = spelled(odd, self.trie)
            out += [f for f in self.word_features(start or "") if f not in out]
        return out

    @staticmethod
    def word_features(word: str) -> tuple[str, ...]:
        return (word + " ", *(word[:n] for n in STARTS if len(word) >= n)) if len(word) > 2 else ()

    def hits(self, token: str) -> tuple[str, ...]:
        """The features of a token that are in use. A word with marks around it is looked up as the word."""
        found = self.known.get(token)
        if found is None:
            found = self.before.get(token)
            if found is None:
                odd = token.rstrip(TAIL).lstrip(HEAD)
                if odd.isalpha() and not REPEATED.search(odd):
                    found = self.known.get(odd) if odd != token else None
                    if found is None:
                        found = tuple(f for f in self.word_features(odd) if f in self.used)
                else:
                    found = tuple(f for f in self.features(token) if f in self.used)
            if len(self.known) >= KNOWN:
                self.known, self.before = {}, self.known
            self.known[token] = found
        return found

    def score(self, text: str) -> tuple[float, list[str]]:
        """The probability that a text is toxic, and the features that speak for it."""
        found = counted(Counter(tokens(text)), self.hits)
        z = self.bias + sum(self.weights.get(f, 0.0) for f in found)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return max([p, *(self.sure[f] for f in found if f in self.sure)]), sorted(f for f in found if self.weights.get(f, 0.0) > 0)


def counted(words: Counter, features) -> list[str]:
    """The features of a text's tokens, and those of their counts."""
    n: Counter = Counter()
    for t, c in words.items():
        if found := features(t):
            for f in found:
                n[f] += c
    return [*n, *(f"{f}#{k}" for k in COUNTS for f, c in n.items() if c >= k)]


def tokens(text: str) -> list[str]:
    """Lower-case tokens between white space; runs of single characters, with their spaces, are one token more."""
    low = text.lower()
    out = low.split()
    return out + [m[0] for m in SPACED.finditer(low)] if SPACED.search(low) else out


def group(found: list[str]) -> int:
    """One minimum hash of a text's runs of three tokens, which its near copies mostly share."""
    return min((zlib.crc32(" ".join(found[i : i + 3]).encode()) for i in range(max(1, len(found) - 2))), default=0)


def _count_letters(batches):
    total = np.zeros(SIZE**3, np.int64)
    for big in batches:
        for batch in small_batches(big, 4096, 2 << 20, 0):
            total += letter_counts(batch.column(0).to_pylist())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])


def _toxic_features(batches, model: Model):
    features = lru_cache(FITTED)(model.features)
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            found = tokens(text)
            g = group(found)
            out += [(f, g) for f in counted(Counter(found), features)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()), strict=True)], ["feature", "group"])


def _clean_features(batches, model: Model, wanted: frozenset):
    n: Counter = Counter()
    features = lru_cache(FITTED)(lambda token: tuple(f for f in model.features(token) if f in bare))
    bare = frozenset(f.split("#")[0] for f in wanted)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n.update(f for f in counted(Counter(tokens(text)), features) if f in wanted)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])


def _examples(batches, model: Model, place: dict):
    """For each text its label, its group and the places of its features that are in use."""
    bare = frozenset(f.split("#")[0] for f in place)
    features = lru_cache(FITTED)(lambda token: tuple(f for f in model.features(token) if f in bare))
    for batch in batches:
        out = []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = tokens(text)
            out.append((label, group(words), [place[f] for f in counted(Counter(words), features) if f in place]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["label", "group", "found"])


def logistic(found: list[list[int]], labels: np.ndarray, weights: np.ndarray, size: int, ridge: float = 0.05, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights of so many features and the bias of a ridge logistic regression, by accelerated gradients."""
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    col = np.array([j for x in found for j in x], np.int64)
    w, bias = np.zeros(size), -2.0
    ahead, ahead_bias = w.copy(), bias
    spread = np.bincount(row, minlength=len(found)) + 1.0
    step = 1 / (0.25 * np.max(np.bincount(col, weights=(weights * spread)[row], minlength=max(size, 1)), initial=1.0) + ridge)
    bias_step = 1 / (0.25 * float((weights * spread).sum()) + 1e-9)
    for i in range(rounds):
        z = ahead_bias + np.bincount(row, weights=ahead[col], minlength=len(found))
        g = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        new, new_bias = ahead - step * (np.bincount(col, weights=g[row], minlength=size) + ridge * ahead), ahead_bias - bias_step * g.sum()
        k = i / (i + 3)
        ahead, ahead_bias = new + k * (new - w), new_bias + k * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


def tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of k or more hits in n, each of chance p; an upper bound (Chernoff)."""
    share = k / n
    if share <= p:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0
    return -n * (share * math.log(share / p) + rest)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, scratch: Scratch, most_labelled: int = 20_000) -> Model:
    """The model of these documents.

    The letters are counted over all texts. The features are chosen from at most ``most_labelled`` labelled
    rows (a documented bound; those with the least hash of the key): words, starts of words and their counts in
    so many different toxic texts (the square of their number over the sum of squares by group(), so that copies
    count little) and so few clean ones that chance
    among all tried is under one in a hundred. A ridge logistic regression weighs them, in which a copy
    counts the less the more copies there are; a feature of 30 such toxic texts and no clean one is sure.
    """
    modest_batches(docs.sparkSession)
    grams = docs.select(full_text(text).alias("text")).mapInArrow(_count_letters, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3, np.int64)  # at most SIZE^3 rows, whatever the corpus
    for r in grams.collect():
        counts[r["gram"]] = r["n"]
    blank = Model(Letters.of(counts))
    sample = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(toxic).cast("int").alias("toxic"))
    sample = sample.groupBy("_key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_key"), "_key").limit(most_labelled)
    given = docs.select(F.col(key).alias("_id"), full_text(text).alias("text"))
    rows = scratch.cut(given.join(F.broadcast(sample), F.col("_id") == F.col("_key")).select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return blank
    least = max(3, bad // 100)
    of = lambda label: rows.where(F.col("toxic") == label).select("text")
    grouped = of(1).mapInArrow(partial(_toxic_features, model=blank), "feature string, group long").groupBy("feature", "group").agg(F.count("*").alias("n"))
    alike = (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).cast("long")
    found = grouped.groupBy("feature").agg(alike.alias("n")).where(F.col("n") >= least)
    toxic_n = {r["feature"]: r["n"] for r in found.collect()}  # each is in one of a hundred of the bounded sample's toxic texts
    clean = of(0).mapInArrow(partial(_clean_features, model=blank, wanted=frozenset(toxic_n)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    clean_n = {r["feature"]: r["n"] for r in clean.collect()}
    share, limit = bad / (bad + good), math.log(0.01 / max(1, len(toxic_n)))
    used, sure = [], {}
    for f, n in sorted(toxic_n.items()):
        m = clean_n.get(f, 0)
        if n * good >= 3 * m * bad and tail(n, n + m, share) < limit:
            used.append(f)
        if m == 0 and n >= 30:
            sure[f] = (n + 0.5) / (n + 1)
    place = {f: i for i, f in enumerate(used)}
    examples = rows.mapInArrow(partial(_examples, model=blank, place=place), "label int, group long, found array<int>").collect()  # at most most_labelled rows of small integers
    labels_ = np.array([r["label"] for r in examples], float)
    alike = Counter((r["label"], r["group"]) for r in examples)
    weights = np.array([alike[r["label"], r["group"]] ** -0.5 for r in examples])
    w, bias = logistic([r["found"] for r in examples], labels_, weights, len(used))
    return Model(blank.letters, {f: float(w[i]) for f, i in place.items()} | {f: 0.0 for f in sure if f not in place}, bias, sure)


def _score(batches, model: Model):
    for big in batches:
        for batch in small_batches(big, 4096, 4 << 20, 0):
            found = [model.score(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.list_(pa.string()))], ["base", "score", "reasons"])


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with columns score (0 to 1) and reasons (what of the lexicon is in the text); a narrow job.

    A null text is empty, and an empty text has the score of texts without a reason. Repeated rows come back
    as often, an empty table stays empty, and columns with the added names are replaced.
    """
    from pyspark.sql import types as T

    modest_batches(docs.sparkSession)
    kept = docs.drop("score", "reasons")
    given = kept.select(full_text(text).alias("text"), F.struct(*kept.columns).alias("base"))
    schema = T.StructType([T.StructField("base", given.schema["base"].dataType), T.StructField("score", T.DoubleType()), T.StructField("reasons", T.ArrayType(T.StringType()))])
    return given.mapInArrow(partial(_score, model=model), schema).select("base.*", "score", "reasons")


def held_out(key: str) -> F.Column:
    """Whether a row's label is kept from fitting: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def detect_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", threshold: float = 0.7, most_labelled: int = 20_000) -> DataFrame:
    """docs with columns held_out, score, reasons and predicted (1 from the threshold on).

    Fits on labels of rows that are not held out and scores every whole text. Each text is read three
    times and moves nowhere: to count letters, to find the sample, and to be scored. A null key is not
    held out and has no label; without toxic or without clean labels every score is near 0.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels.where(~held_out(key)), key, text, toxic, scratch, most_labelled)
    out = score_texts(docs, model, text)
    return out.withColumn("held_out", held_out(key)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
