"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neardup import shingles
from .sampling import held_out, labelled, logistic

#: Common insults by language; a lexicon is a voter and needs no label.
INSULTS = {
    "english": "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool imbecile jerk filth filthy vermin pig bastard creep",
    "german": "idiot idioten trottel dumm dummkopf versager abschaum arschloch schwein schweine depp volltrottel spinner dreck drecksack widerlich erbärmlich wertlos müll lügner verlierer blödmann ekelhaft penner",
    "french": "idiot idiote imbécile crétin abruti débile connard connasse salaud salope ordure raclure pourriture minable pathétique stupide dégoûtant bouffon nul perdant déchet racaille",
    "spanish": "idiota idiotas imbécil estúpido estúpida tonto basura escoria asqueroso patético inútil payaso cerdo perdedor mierda cabrón gilipollas tarado cretino bastardo repugnante",
    "italian": "idiota idioti stupido cretino imbecille deficiente schifoso spazzatura feccia patetico inutile pagliaccio perdente bastardo stronzo verme disgustoso",
    "portuguese": "idiota burro estúpido imbecil otário lixo escória nojento patético inútil palhaço perdedor babaca porco desgraçado",
}
LEXICONS = {k: frozenset(v.split()) for k, v in INSULTS.items()}
EVERY = frozenset().union(*LEXICONS.values())

WORDS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[A-Z]{3,}[!?]{1,}")
STRETCH = re.compile(r"([^\W\d_])\1\1+")
MASKED = re.compile(r"[^\W\d_]+[0134578@$][\w@$]*[^\W_]")
UNMASK = str.maketrans("0134578@$", "oieastbas")
_ANY = "|".join(sorted(EVERY))
ADDRESSED = re.compile(rf"\b(?:you|your|youre|ur|du|dich|dein|deine|ihr|euch|tu|toi|ton|vous|votre|eres|tú|usted|sei|você|voce)\b\W+(?:\w+\W+){{0,3}}?(?:{_ANY})\b")
EXCLAIMED = re.compile(rf"\b(?:{_ANY})\b\s*[!?]")
#: Voters after the mined terms: one a language, and one a pattern.
PATTERNS = ("addressed", "exclaimed", "disguised", "shouted", "repeated", "several", "none")
#: Letters of beginnings that count as terms, and of those that count when several words of a document share them.
PREFIX, SHARED = (4, 5, 6), (4, 5, 6, 7)
#: Least share of a document's words that a shared beginning has; at least two words.
DENSE = 0.008
#: Votes: for, abstain, against.
FOR, NONE, AGAINST = 1, 0, -1


def terms(text: str) -> set[str]:
    """Words in lower case, their first 4, 5 and 6 letters marked by a final *, and beginnings that many of the words have by **."""
    every = WORDS.findall(text.lower())
    words = set(every)
    out = set(words)
    for n in PREFIX:
        out.update([f"{w[:n]}*" for w in words if len(w) > n])
    least = max(2, DENSE * len(every))
    for n in SHARED:
        out.update([f"{w}**" for w, m in Counter([w[:n] for w in every if len(w) >= n]).items() if m >= least])
    return out


def originals(texts: list[str], threshold: float = 0.8, size: int = 5, block: int = 200) -> list[int]:
    """Indices of the texts that are no copy of an earlier one of them. A copy has a Jaccard similarity of at least
    `threshold` by its sets of five-word shingles (a text of fewer words is one shingle; one without words must be equal).

    Sets this similar share one of their rarest 1 - threshold shingles, so only those propose pairs; none is missed."""
    sets = []
    for i in range(0, len(texts), block):
        part = texts[i : i + block]
        who, h, *_ = shingles(part, size)
        sets += np.split(h, np.searchsorted(who, np.arange(1, len(part))))
    every, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
    every, n = every[n > 1], n[n > 1]
    kept, bare, holders = [], set(), {}
    for i, a in enumerate(sets):
        if not len(a):
            if texts[i] not in bare:
                bare.add(texts[i])
                kept.append(i)
            continue
        place = np.searchsorted(every, a)
        place = place[(place < len(every)) & (every[np.minimum(place, len(every) - 1)] == a)] if len(every) else place[:0]
        least = int(np.ceil(threshold * len(a) - 1e-9))
        # Shingles of this text alone are rarer than all others.
        rare = max(0, len(a) - least + 1 - (len(a) - len(place)))
        rare = every[place[np.lexsort((place, n[place]))[:rare]]].tolist()
        near = {j for x in rare for j in holders.get(x, ()) if least <= len(sets[j]) and len(sets[j]) * threshold <= len(a) + 1e-9}
        if any((c := len(np.intersect1d(a, sets[j], assume_unique=True))) >= threshold * (len(a) + len(sets[j]) - c) - 1e-9 for j in near):
            continue
        kept.append(i)
        for x in rare:
            holders.setdefault(x, []).append(i)
    return kept


def lexicons(docs: list[np.ndarray], names: list[str], labels: np.ndarray, size: int, support: int) -> list[str]:
    """Terms that toxic training documents have and others hardly ever, by log-odds times root of support. Half of the
    documents propose terms and the other half confirms them, both ways, so that chance finds drop out. Documents are
    the indices of their terms in names."""
    counts = np.zeros((2, 2, len(names)), np.int64)
    for i, (ids, y) in enumerate(zip(docs, labels, strict=True)):
        counts[i % 2, int(y), ids] += 1
    n_pos, n_neg = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    scored, tally, number = [], {}, {}
    (neg_a, pos_a), (neg_b, pos_b) = counts
    for k in np.flatnonzero((pos_a > 4 * neg_a) & (pos_b > 4 * neg_b) & (pos_a + pos_b >= support)).tolist():
        n, neg, t = int(pos_a[k] + pos_b[k]), int(neg_a[k] + neg_b[k]), names[k]
        odds = np.log((n + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        if odds > 3:
            scored.append((-odds * np.sqrt(n), len(t), t))
            tally[t], number[t] = (n, neg), k
    # A beginning gives way to a longer term that has nearly all of its toxic documents and fewer others.
    for _, _, t in list(scored):
        longer = [x for x in tally if x != t and t.endswith("*") and x.startswith(t.rstrip("*")) and tally[x][0] > 0.8 * tally[t][0] and tally[x][1] < tally[t][1]]
        if longer:
            scored = [z for z in scored if z[2] != t]
    scored = sorted(scored)[: 4 * size]
    where: dict[str, list[int]] = {t: [] for *_, t in scored}
    wanted = np.zeros(len(names), bool)
    wanted[[number[t] for t in where]] = True
    for i, ids in enumerate(docs):
        for k in ids[wanted[ids]].tolist():
            where[names[k]].append(i)
    # Of terms that occur in the same documents, one is enough.
    out = {tuple(where[t]): t for *_, t in reversed(scored)}
    return [t for *_, t in scored if out[tuple(where[t])] == t][:size]


def disguised(lower: str) -> bool:
    """Whether an insult is spelt with digits or signs for letters, or with a letter drawn out."""
    if any(w.translate(UNMASK) in EVERY for w in MASKED.findall(lower)):
        return True
    if STRETCH.search(lower) is None:
        return False
    return any(STRETCH.sub(r"\1", w) in EVERY or STRETCH.sub(r"\1\1", w) in EVERY for w in WORDS.findall(lower) if STRETCH.search(w))


def votes(found: list[set[str]], texts: list[str], lexicon: list[str]) -> np.ndarray:
    """One row a document, one column a voter: each mined term; the insults of each language; insults after a second
    person, before an exclamation or question mark, in disguised spelling; shouting; one insult three times or more; two
    different hits or more; and no hit at all, which votes against."""
    place = {t: i for i, t in enumerate(lexicon)}
    out = np.zeros((len(found), len(lexicon) + len(LEXICONS) + len(PATTERNS)), np.int8)
    for i, (terms_, text) in enumerate(zip(found, texts, strict=True)):
        hits = [place[t] for t in terms_ if t in place]
        out[i, hits] = FOR
        insults, lower = terms_ & EVERY, text.lower()
        if insults:
            out[i, len(lexicon) : len(lexicon) + len(LEXICONS)] = [FOR if insults & x else NONE for x in LEXICONS.values()]
        n = len({t.rstrip("*")[:4] for t in insults} | {lexicon[k].rstrip("*")[:4] for k in hits})
        hidden = disguised(lower)
        out[i, -len(PATTERNS) :] = [
            FOR if insults and ADDRESSED.search(lower) else NONE,
            FOR if insults and EXCLAIMED.search(lower) else NONE,
            FOR if hidden else NONE,
            FOR if len(SHOUT.findall(text)) > 3 else NONE,
            FOR if any(len(re.findall(rf"\b{w}\b", lower)) > 2 for w in insults) else NONE,
            FOR if n >= 2 else NONE,
            AGAINST if n == 0 and not hidden else NONE,
        ]
    return out


@dataclass
class LabelModel:
    """A latent class and, given it, each voter's rates of voting for and against. Rates are estimated by expectation
    maximization; a vote's evidence is divided by 1 + the sum of its correlations, given the class, with the other votes
    on that document, so that voters that copy each other do not count many times."""

    prior: float
    rates: np.ndarray  # class, voter, vote
    alike: np.ndarray  # voter, voter

    @classmethod
    def fit(cls, v: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
        n, m = v.shape
        seen = [(v == x).astype(np.float64) for x in (AGAINST, NONE, FOR)]
        # Before the first round a document's class is the majority of its votes.
        post = np.clip(np.where(v.sum(axis=1) > 0, 0.9, 0.1 * prior), 1e-3, 1 - 1e-3)
        alike = np.zeros((m, m))
        for r in range(rounds):
            weight = np.stack([1 - post, post])
            rates = np.stack([weight @ x for x in seen], axis=2) + 0.01
            rates /= rates.sum(axis=2, keepdims=True)
            if r % 5 == 0:
                alike = cls._alike(v, post, rates)
            post = cls(prior, rates, alike).posterior(v)
        return cls(prior, rates, alike)

    @staticmethod
    def _alike(v: np.ndarray, post: np.ndarray, rates: np.ndarray, least: float = 0.1) -> np.ndarray:
        mean = rates[:, :, 2] - rates[:, :, 0]
        total = np.zeros((v.shape[1], v.shape[1]))
        x = v.astype(np.float64)
        for k, w in enumerate((1 - post, post)):
            d = (x - mean[k]) * np.sqrt(w)[:, None]
            c = d.T @ d
            scale = np.sqrt(np.outer(np.diag(c), np.diag(c))) + 1e-9
            total = np.maximum(total, np.abs(c / scale))
        np.fill_diagonal(total, 0)
        return np.where(total > least, total, 0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.log(self.rates[1]) - np.log(self.rates[0])  # voter, vote
        each = np.where(v == FOR, odds[:, 2], np.where(v == AGAINST, odds[:, 0], 0.0))  # an abstention says nothing
        shared = 1 + (v != NONE).astype(np.float64) @ self.alike
        return logistic(np.log(self.prior / (1 - self.prior)) + (each / shared).sum(axis=1))


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray
    bias: float
    #: Rows learnt from: the sample less its copies.
    learnt: int = 0

    @classmethod
    def train(cls, texts: list[str], labels: np.ndarray, size: int, support: int, steps: int = 400) -> Model:
        # Copies of one text would confirm each other's rare words.
        kept = originals(texts)
        texts, labels = [texts[i] for i in kept], np.asarray(labels)[kept]
        # Documents are counted by terms' hashes first: terms of too few to be mined get no number.
        met = np.zeros(1 << 22, np.int32)
        cells = lambda ws: np.fromiter(map(hash, ws), np.int64, len(ws)) & (len(met) - 1)
        for t in texts:
            met[np.unique(cells(terms(t)))] += 1
        number: dict[str, int] = {}
        docs = []
        for t in texts:
            ws = list(terms(t))
            kept = [w for w, n in zip(ws, met[cells(ws)].tolist(), strict=True) if n >= support or w in EVERY]
            docs.append(np.array([number.setdefault(w, len(number)) for w in kept], np.int32))
        names = list(number)
        lexicon = lexicons(docs, names, labels, size, support)
        used = np.zeros(len(names), bool)
        used[[number[t] for t in (*lexicon, *EVERY) if t in number]] = True
        v = votes([{names[k] for k in ids[used[ids]].tolist()} for ids in docs], texts, lexicon)
        soft = LabelModel.fit(v, float(np.clip(labels.mean() if len(labels) else 0.1, 0.01, 0.99))).posterior(v) if len(v) else np.zeros(0)
        x = v.astype(np.float64)
        w, b, mw, vw = np.zeros(x.shape[1]), -2.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for step in range(1, steps + 1 if len(v) else 0):
            g = logistic(x @ w + b) - soft
            grad = np.append(x.T @ g / len(g) + 1e-4 * w, g.mean())
            mw, vw = 0.9 * mw + 0.1 * grad, 0.999 * vw + 0.001 * grad**2
            move = 0.1 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return cls(lexicon, w, float(b), len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        return logistic(votes([terms(t) for t in texts], texts, self.lexicon).astype(np.float64) @ self.weights + self.bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8000, chars: int = 50_000, size: int = 300, support: int = 4) -> Model:
    """Learn from at most `rows` labelled documents; of a text of over `chars` characters, from slices spread over all of it."""
    sample = labelled(docs, labels, "toxic", rows, chars)
    return Model.train(sample["text"].tolist(), sample["label"].to_numpy().astype(int), size, support)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) as `row` struct, with its score; texts of any length are read whole.

    Null and empty texts have no term and get the score of a document without any; equal texts get equal scores; an
    empty table gives an empty result; extra columns come back in `row`.
    """
    held = spark.sparkContext.broadcast(model)  # a few hundred terms

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series(np.concatenate([held.value.score([t or "" for t in text.iloc[i : i + 500]]) for i in range(0, len(text), 500)] or [np.zeros(0)]))

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), scored(docs["text"]).alias("score"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(row, score, held_out, predicted): labels of rows outside the held-out fold alone are learnt from, at most 8,000."""
    out = score(spark, docs, fit(docs, labels, **options))
    return out.select("row", "score", held_out(F.col("row.doc_id")).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))
