"""Subject areas of documents by labelling functions and a latent model of their accuracies (problem 10).

Each sentence is judged by several labelling functions: its words (a strong or a weak vote), its section, that is
the sentences around it, the document's source and its address (the kind of component it is filed under). What the
functions go by is learned: first from a bounded sample of hand labels, then from the whole corpus, voted by that.
An EM over the votes of all sentences learns how far each function can be trusted; the posterior decides each
sentence, and the sentences the document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.llm.words import Numbers, batch_sentences
from molquarry.runtime import Scratch

#: Documents of the hand-labelled sample that the first lexicon is learned from, at most.
LABELLED = 4_000
#: Strong votes that a word needs for the lexicon, and votes that a source or address needs to speak.
LEAST_VOTES, LEAST_META = 5, 50
#: Share of its sentences that a document's subject needs.
SHARE = 0.25
#: Words that a line needs to be a sentence. Fewer are codes, figures or headings.
LEAST_WORDS = 4
#: A line of at most FURNITURE_WORDS words that stands in this share of the documents, eight at least, is page furniture.
FURNITURE_SHARE, FURNITURE_WORDS = 0.004, 30
#: Labelling functions and what is first thought of their accuracy; EM moves it, weighed against this share of the votes.
FUNCTIONS, FIRST_ACCURACY, PRIOR_WEIGHT = ("strong words", "weak words", "section", "source", "address"), (0.97, 0.85, 0.7, 0.2, 0.2), 0.2
#: A source or address votes for a subject that is so many times as frequent there as elsewhere.
LIFT = 1.3
_BATCH = 2000


def log_odds(counts: np.ndarray, totals: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Of each word (row) for each subject: log of its rate there over its rate in the others taken together."""
    rate = (counts + smooth * totals / totals.sum()) / (totals + 1.0)
    rest = (rate.sum(1, keepdims=True) - rate) / (counts.shape[1] - 1)
    return np.log(np.maximum(rate, 1e-12) / np.maximum(rest, 1e-12))


#: Words, and sources and addresses, are counted by so many slots of their hashes: what is broadcast has one size, however many there are.
WORD_SLOTS, META_SLOTS = 1 << 22, 1 << 16


def slots_of(names: list[str], slots: int = WORD_SLOTS) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) & np.uint64(slots - 1)).astype(np.int64)


def meta_slot(c: Column) -> Column:
    """The slot of a source or address, 0 for none."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(1 + F.pmod(F.xxhash64(c), F.lit(META_SLOTS - 1))).cast("int")


class Lexicon:
    """The subject that the words of each slot speak for, and their weight, 0 where they speak for none; hashes of furniture lines."""

    def __init__(self, slots: np.ndarray, subject: np.ndarray, weight: np.ndarray, k: int, furniture: frozenset[int] = frozenset()):
        self.k, self.furniture = k, furniture
        self.subject, self.weight = np.zeros(WORD_SLOTS, np.uint8 if k < 256 else np.int32), np.zeros(WORD_SLOTS, np.float32)
        speaks = weight > 1.0
        self.subject[slots[speaks]], self.weight[slots[speaks]] = subject[speaks], np.minimum(weight[speaks], 4.0)


class Judge:
    """Judges batches of texts by a lexicon, numbering words as they come."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.furniture = np.sort(np.fromiter(lexicon.furniture, np.uint64, len(lexicon.furniture)))
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.subject, self.weight, self.hash = np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.uint64)

    def _grown(self) -> None:
        new = self.number.words[len(self.subject) - 1 :]
        if new:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            slot = (hashes & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
            self.subject = np.concatenate([self.subject, self.lexicon.subject[slot].astype(np.int64)])
            self.weight = np.concatenate([self.weight, self.lexicon.weight[slot].astype(float)])
            self.hash = np.concatenate([self.hash, hashes])

    def judge(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(words' numbers, sentence of each word, first token, length, line hash, text, vote or -1, whether strong) of the sentences that count."""
        tokens, numbers, first, last, text = batch_sentences(texts, self.number)
        self._grown()
        size = last - first
        keep = size >= LEAST_WORDS
        first, size, text = first[keep], size[keep], text[keep]
        n = len(first)
        owner = np.repeat(np.arange(n), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        words = numbers[np.repeat(first, size) + place] if n else np.zeros(0, np.int32)
        with np.errstate(over="ignore"):
            mixed = (self.hash[words] ^ place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            line = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), np.cumsum(size) - size) if n else np.zeros(0, np.uint64)
        if len(self.furniture) and n:
            at = np.minimum(np.searchsorted(self.furniture, line), len(self.furniture) - 1)
            keep = (self.furniture[at] != line) | (size > FURNITURE_WORDS)
            inside = keep[owner]
            renumbered = np.cumsum(keep) - 1
            words, owner = words[inside], renumbered[owner[inside]]
            first, size, text, line = first[keep], size[keep], text[keep], line[keep]
            n = len(first)
        k = self.lexicon.k
        speaks = self.weight[words] > 0
        scores = np.bincount(owner[speaks] * k + self.subject[words[speaks]], self.weight[words[speaks]], n * k).reshape(n, k)
        top = scores.max(1) if n else np.zeros(0)
        vote = np.where(top > 0, scores.argmax(1), -1) if n else np.zeros(0, np.int64)
        second = np.partition(scores, k - 2, axis=1)[:, k - 2] if n and k > 1 else np.zeros(n)
        return words, owner, first, size, line, text, vote, top - second > 4.0


def first_lexicon(documents: DataFrame, labels: DataFrame, subjects: list[str], key: str, text: str) -> Lexicon:
    """From a sample of at most LABELLED hand-labelled documents, chosen by a hash of their keys."""
    rank = {s: i for i, s in enumerate(subjects)}
    picked = labels.filter(F.col("subject").isin(subjects)).groupBy(key).agg(F.collect_set("subject").alias("subjects"))
    picked = picked.orderBy(F.xxhash64(key), key).limit(LABELLED)
    sample = picked.join(documents.select(key, text).filter(F.col(text).isNotNull()), key).select("subjects", text).toPandas()
    counts: dict[int, np.ndarray] = {}
    totals, number = np.zeros(len(subjects)), Numbers()
    for names, own in zip(sample["subjects"], sample[text]):
        share = np.zeros(len(subjects))
        share[[rank[s] for s in names]] = 1 / len(names)
        totals += share
        tokens, _, first, last, _ = batch_sentences([own], number)
        words = sorted({w for a, z in zip(first, last) if z - a >= LEAST_WORDS for w in tokens[a:z]})
        for slot in np.unique(slots_of(words)).tolist():
            counts[slot] = counts[slot] + share if slot in counts else share.copy()
    known = np.asarray(sorted(x for x, c in counts.items() if c.sum() >= 2), np.int64)
    table = np.stack([counts[x] for x in known.tolist()]) if len(known) else np.zeros((0, len(subjects)))
    weights = log_odds(table, totals) * (1 - np.exp(-table.sum(1, keepdims=True) / 2)) if len(known) else np.zeros((0, len(subjects)))
    return Lexicon(known, weights.argmax(1), weights.max(1, initial=0.0), len(subjects))


#: Words that a task numbers before it hands on its counts and begins anew.
REMEMBERED = 300_000


def _spread(shared, documents: DataFrame, text: str, extras: list[str]) -> DataFrame:
    """What the corpus says, by kind: slots of words and of metadata by subject, lines by the number of texts, documents.

    Each of c copies of a text counts 1/c in words, lines and documents, wherever they stand.
    """
    k = shared.value.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        words = np.zeros((1, k))
        lines: Counter = Counter()
        other: dict[int, np.ndarray] = {}
        n = 0.0

        def flush() -> pa.RecordBatch:
            nonlocal words, n
            known = np.flatnonzero(words.any(1))
            slot, place = np.unique((judge.hash[known] & np.uint64(WORD_SLOTS - 1)).astype(np.int64), return_inverse=True)
            summed = np.zeros((len(slot), k))
            np.add.at(summed, place.reshape(-1), words[known])
            kinds = ["w"] * len(slot) + ["m"] * len(other) + ["l"] * len(lines) + ["n"]
            names = pa.array(np.concatenate([slot, np.fromiter(other, np.int64, len(other)), np.fromiter(lines, np.uint64, len(lines)).view(np.int64), np.zeros(1, np.int64)]))
            table = np.concatenate([summed, np.asarray([*other.values()]).reshape(-1, k)])
            much = [0.0] * len(table) + [*lines.values(), n]
            by = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, k, dtype=np.int32)), pa.array(table.ravel()))
            by = pa.concat_arrays([by, pa.nulls(len(lines) + 1, by.type)])
            out = pa.RecordBatch.from_arrays([pa.array(kinds), names, by, pa.array(much, pa.float64())], names=["kind", "name", "by", "n"])
            words, n = np.zeros((1, k)), 0.0
            lines.clear(), other.clear(), judge.forget()
            return out

        for b in batches:
            for start in range(0, b.num_rows, _BATCH):
                part = b.slice(start, _BATCH)
                texts = part.column(0).to_pylist()
                weight = part.column(1 + len(extras)).to_numpy()
                n += float(weight.sum())
                numbers, owner, _, size, line, text_of, vote, strong = judge.judge(texts)
                counts, few = weight[text_of], size <= FURNITURE_WORDS
                short, code = np.unique(line[few], return_inverse=True)
                for x, c in zip(short.tolist(), np.bincount(code.reshape(-1), counts[few], len(short)).tolist()):
                    lines[x] += c
                use = strong[owner]
                words = np.concatenate([words, np.zeros((len(judge.number.words) + 1 - len(words), k))])
                words += np.bincount(numbers[use].astype(np.int64) * k + vote[owner[use]], counts[owner[use]], words.size).reshape(words.shape)
                voted = vote >= 0
                for e in range(len(extras)):
                    names, code = np.unique(part.column(1 + e).to_numpy(), return_inverse=True)
                    table = np.bincount(code[text_of[voted]] * k + vote[voted], minlength=len(names) * k).reshape(-1, k)
                    for name, c in zip(names.tolist(), table):
                        key = e * META_SLOTS + name
                        other[key] = other[key] + c if key in other else c.astype(float)
                if len(judge.number.words) > REMEMBERED or len(lines) > REMEMBERED:
                    yield flush()
        yield flush()

    own = documents.select(text, *extras).filter(F.col(text).isNotNull()).withColumns({"_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(1), text)})
    copied = own.groupBy("_h", "_g").agg(F.count("*").alias("_c")).filter("_c > 1")
    weighted = own.join(copied, ["_h", "_g"], "left").select(text, *extras, (1 / F.coalesce("_c", F.lit(1))).alias("_w"))
    return weighted.mapInArrow(run, "kind string, name long, by array<double>, n double")


def learn(documents: DataFrame, labels: DataFrame, subjects: list[str], key: str, text: str, extras: list[str]) -> tuple[Lexicon, list[np.ndarray]]:
    """The corpus-wide lexicon with the furniture lines, and what each slot of sources and addresses votes for, -1 for nothing.

    To the driver come at most WORD_SLOTS slots of words, META_SLOTS of each kind of metadata, and lines that so many
    documents hold that each document's lines divided by FURNITURE_SHARE bounds them.
    """
    spark = documents.sparkSession
    k = len(subjects)
    start = first_lexicon(documents, labels, subjects, key, text)
    shared = spark.sparkContext.broadcast(start)
    by = F.array(*(F.sum(F.col("by")[i]) for i in range(k)))
    found = _spread(shared, documents, text, extras).groupBy("kind", "name").agg(by.alias("by"), F.sum("n").alias("n")).withColumn("all", F.aggregate("by", F.lit(0.0), lambda a, x: a + x))
    found = Scratch(spark).keep(found)
    n_documents = found.filter("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    least = max(8, int(n_documents * FURNITURE_SHARE))
    furniture = frozenset(int(r["name"]) % 2**64 for r in found.filter(f"kind = 'l' and n >= {least - 1e-6}").select("name").collect())
    votes = [np.full(META_SLOTS, -1, np.int64) for _ in extras]
    meta = [(r["name"], np.asarray(r["by"])) for r in found.filter(f"kind = 'm' and all >= {LEAST_META}").orderBy("name").collect()]
    for e in range(len(extras)):
        own = {n % META_SLOTS: c for n, c in meta if n // META_SLOTS == e}
        total = sum(own.values()) if own else None
        for slot, c in own.items():
            lift = (c / c.sum()) / np.maximum(total / total.sum(), 1e-9)
            if lift.max() >= LIFT and slot:
                votes[e][slot] = int(lift.argmax())
    counted = found.filter(f"kind = 'w' and all >= {LEAST_VOTES - 1e-6}")
    totals = np.asarray(counted.agg(by.alias("t")).first()["t"], float)
    if np.isnan(totals).any():
        return start, votes
    # Only the slots' subjects and weights leave the executors, as log_odds has them.
    whole = totals + 1
    rate = [(F.col("by")[i] + float(0.5 * whole[i] / whole.sum())) / float(whole[i] + 1) for i in range(k)]
    every = sum(rate[1:], rate[0])
    odds = F.array_max(F.array(*(F.struct((F.ln(F.greatest(r, F.lit(1e-12))) - F.ln(F.greatest((every - r) / max(k - 1, 1), F.lit(1e-12)))).cast("float").alias("w"), F.lit(-i).alias("i")) for i, r in enumerate(rate))))
    words = counted.select("name", odds.alias("o")).select("name", (-F.col("o.i")).alias("subject"), F.col("o.w").alias("weight")).toPandas()
    # Slots that the hand labels knew but the corpus hardly has stay as they were.
    weight, subject = start.weight.copy(), start.subject.copy()
    weight[words["name"]], subject[words["name"]] = words["weight"], words["subject"]
    slot = np.flatnonzero(weight)
    return Lexicon(slot, subject[slot], weight[slot], k, furniture), votes


def accuracies(patterns: np.ndarray, counts: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Posterior subject probabilities of each vote pattern (row): -1 stands for no vote.

    The latent subject of a sentence is voted for rightly by function j with probability a_j, wrongly with the rest
    shared evenly; EM finds priors and accuracies from the counts of all patterns.
    """
    accuracy = np.asarray(FIRST_ACCURACY)
    prior = np.full(k, 1 / k)
    voted = patterns >= 0
    hits = np.stack([np.where(voted, patterns == y, False) for y in range(k)], 2)  # pattern, function, subject
    posterior = np.full((len(patterns), k), 1 / k)
    for _ in range(rounds):
        log = np.log(prior)[None, :] + np.zeros((len(patterns), k))
        for j, a in enumerate(accuracy):
            own = np.where(hits[:, j], np.log(a), np.log((1 - a) / (k - 1)))
            log += np.where(voted[:, j, None], own, 0.0)
        log -= log.max(1, keepdims=True)
        posterior = np.exp(log)
        posterior /= posterior.sum(1, keepdims=True)
        mass = posterior * counts[:, None]
        prior = (mass.sum(0) + 1) / (mass.sum() + k)
        right = np.einsum("pk,pjk->j", mass, hits)
        votes = (voted * counts[:, None]).sum(0)
        weight = PRIOR_WEIGHT * votes + 10
        accuracy = np.clip((right + weight * np.asarray(FIRST_ACCURACY)) / (votes + weight), 1 / k, 0.999)
    return posterior


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", address: str = "component_id") -> DataFrame:
    """(key, subject, share): each document with each subject that at least SHARE of its sentences treat.

    Lines of fewer than LEAST_WORDS words, codes and page furniture are no sentences; a document without sentences
    has no row. Null and blank texts have none; repeated rows are judged each as one document if their keys are equal.
    The two passes read whole texts; only the words, lines, sources and addresses that are frequent enough to count and the
    counts of vote patterns come to the driver. Without labels nothing can be learned and the result is empty.
    """
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in subjects.select("subject").distinct().collect() if r["subject"])  # the few that documents are measured by
    schema = f"{key} long, subject string, share double"
    if not names:
        return spark.createDataFrame([], schema)
    kind = F.regexp_extract(F.coalesce(F.col(address).cast("string"), F.lit("")), "^([A-Za-z]*[0-9]*?)[_-]", 1)
    docs = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text), meta_slot(F.col(source).cast("string")).alias("_source"), meta_slot(kind).alias("_address"))
    lexicon, meta = learn(docs, labels, names, key, text, ["_source", "_address"])
    shared = spark.sparkContext.broadcast((lexicon, meta))
    k = len(names)
    base = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, (by_source, by_address) = shared.value
        judge = Judge(lex)
        for b in batches:
            for start in range(0, b.num_rows, _BATCH):
                part = b.slice(start, _BATCH)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                if len(judge.number.words) > REMEMBERED:
                    judge.forget()
                *_, text_of, vote, strong = judge.judge(part.column(1).to_pylist())
                if not len(vote):
                    continue
                before, after = np.full(len(vote), -1), np.full(len(vote), -1)
                same = text_of[1:] == text_of[:-1]
                before[1:][same], after[:-1][same] = vote[:-1][same], vote[1:][same]
                section = np.where(before == after, before, np.where(before < 0, after, np.where(after < 0, before, -1)))
                sources, addresses = (d[part.column(c).to_numpy()] for c, d in ((2, by_source), (3, by_address)))
                code = np.zeros(len(vote), np.int64)
                for v in (np.where(strong, vote, -1), np.where(strong, -1, vote), section, sources[text_of], addresses[text_of]):
                    code = code * base + v + 1
                pair = np.stack([text_of, code], 1)
                unique, n = np.unique(pair, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[unique[:, 0]]), pa.array(unique[:, 1]), pa.array(n.astype(np.int64))], names=[key, "code", "n"])

    votes = Scratch(spark).keep(docs.mapInArrow(run, f"{key} long, code long, n long"))
    seen = votes.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    if not len(seen):
        return spark.createDataFrame([], schema)
    codes = seen["code"].to_numpy()
    digits = np.stack([codes // base ** (len(FUNCTIONS) - 1 - j) % base - 1 for j in range(len(FUNCTIONS))], 1)
    posterior = accuracies(digits, seen["n"].to_numpy().astype(float), k)
    sure = (posterior.max(1) >= 0.5) & (digits[:, :3] >= 0).any(1)
    decided = spark.createDataFrame([(int(c), names[int(p.argmax())] if s else None) for c, p, s in zip(codes, posterior, sure)], "code long, subject string")
    whole = votes.groupBy(key).agg(F.sum("n").alias("all"))
    treated = votes.join(decided, "code").filter("subject is not null").groupBy(key, "subject").agg(F.sum("n").alias("n"))
    return treated.join(whole, key).select(key, "subject", (F.col("n") / F.col("all")).alias("share")).filter(F.col("share") >= SHARE - 1e-9)


def corpus_composition(found: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """By subject: documents that treat it, and their characters."""
    return found.join(documents.select(key, F.length("text").cast("long").alias("chars")), key).groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("chars").alias("n_chars"))
