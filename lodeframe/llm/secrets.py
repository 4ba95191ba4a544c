"""Secret scans: candidates from the texts, and a random forest that takes the false positives out.

A candidate is a maximal run of at least `MIN_LENGTH` of the characters A-Z a-z 0-9 + / = _ - that has a digit, or is of 20 and more and
mixes cases inside. A second form, of any length and alphabet, is the value assigned (= : := => ==) to a name with one of the words FOR in
it: up to the closing quote of the same line, or to the next space or quote. A value of the second form that is also one of the first is one
candidate. Whole texts are scanned, without a limit on candidates. Features of a candidate: length, shares of character
classes, entropy, changes of class from one character to the next, how usual its character transitions are (the corpus' own table of
byte pairs, counted over all texts), how much of it dictionary words cover, whether it is in a path or URL, what stands around it (quotes,
assignment), and how much the neighbouring words speak for a secret.

The dictionary is the corpus' own: all words of WORD_LETTERS letters and more that stand in one of WORD_SHARE documents or more often,
known by a bit each. What neighbouring words say is learnt from the labelled findings: the logarithm of how much more often a word stands
beside secrets than beside others; a list of names of secrets adds how near one of them is.

The forest is trained on labelled findings: a table (before, candidate, after, label). `labelled_findings` makes one of a bounded,
documented size from a seed: keys, tokens and passwords in their usual forms and places against digests, ids, numbers, paths, names and
placeholders.

Defined cases: null and empty texts have no candidates; the same candidate at several places is a finding at each; repeated rows and null
ids give their own findings; an empty table gives an empty result; a probability equal to the least one is a secret; a very long text is
scanned whole, in one task; the result has columns of its own, so names of other columns don't matter. Positions count bytes of the
UTF-8 text. Ids are whole numbers.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import WORD_BYTES, load, mix, named, prefix_hash, rows_of, split_words, substring_hash, text_chunks, word_hashes

MIN_LENGTH = 12
MIXED_LENGTH = 20
AROUND = 48
FINDINGS = 6000
TREES, DEPTH = 40, 8
WORD_LETTERS, WORD_SHARE, WORD_BITS = 4, 2000, 24
_CHARS = np.zeros(256, bool)
_CHARS[[ord(c) for c in string.ascii_letters + string.digits + "+/=_-"]] = True
_DIGITS = np.array([48 <= c <= 57 for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LOWER = np.array([97 <= c <= 122 for c in range(256)])

#: Fixed words: names of secrets; names of other things and parts of names, of which made-up findings are built.
FOR = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "private", "access")
AGAINST = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "revision", "uuid", "guid", "isbn", "order", "phone", "card", "tel", "id", "version", "etag", "build", "page", "number")
KNOWN = ("access", "admin", "application", "change", "client", "config", "content", "default", "dummy", "example", "file", "handler", "here", "index", "insert", "item", "list", "manager", "name", "number", "page", "password", "placeholder", "replace", "sample", "server", "service", "session", "test", "this", "token", "user", "value", "version", "with", "your")

NAMES = ("length", "digits", "upper", "lower", "symbols", "entropy", "changes", "usual", "covered", "slashes", "in_path", "quoted", "assigned", "neighbours", "best_neighbour", "distance_for", "hex", "numeric", "distinct", "longest_digits")


_SUBWORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[a-z0-9]+")
_LETTERS = np.array([97 <= (c | 32) <= 122 and c < 128 for c in range(256)])


def _bits(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return substring_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]


class Model:
    """What features are measured by: byte transitions and dictionary of the corpus, odds of neighbouring words."""

    def __init__(self, table: np.ndarray, dictionary: np.ndarray, odds: dict[str, float]):
        self.table, self.dictionary, self.odds = table, dictionary, odds
        self._known: dict[str, bool] = {}

    def knows(self, word: str) -> bool:
        if word not in self._known:
            if len(self._known) > 1 << 16:
                self._known.clear()
            bit = int(_bits(np.array([_hash_of(word)]))[0])
            self._known[word] = bool(self.dictionary[bit >> 3] >> (bit & 7) & 1)
        return self._known[word]


def neighbours(before: bytes, after: bytes) -> tuple[list[str], list[str]]:
    """(words before, those right beside): the last four before and the first two after."""
    left = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", before.decode("utf-8", "replace")).lower())
    right = _WORD.findall(after.decode("utf-8", "replace").lower())
    return left, left[-4:] + right[:2]


def _features(before: bytes, found: bytes, after: bytes, model: Model) -> list[float]:
    raw = np.frombuffer(found, np.uint8)
    n = len(raw)
    kinds = np.select([_DIGITS[raw], _UPPER[raw], _LOWER[raw]], [0, 1, 2], 3)
    counts = np.bincount(raw)
    p = counts[counts > 0] / n
    plain = found.decode("latin-1")  # a character for each byte
    low = plain.lower()
    covered = sum(len(w) for w in _SUBWORD.findall(plain) if len(w) >= WORD_LETTERS and model.knows(w.lower()))
    left = before.decode("utf-8", "replace")
    words, near = neighbours(before, after)
    said = [model.odds.get(w, 0.0) for w in near]
    reach = [len(words) - k for k, w in enumerate(words) if w in FOR]
    stem = left.split()[-1] if left and not left[-1].isspace() else ""
    return [
        float(n),
        *(float(np.mean(kinds == k)) for k in range(4)),
        float(-(p * np.log2(p)).sum()),
        float(np.mean(kinds[1:] != kinds[:-1])) if n > 1 else 0.0,
        float(model.table[raw[:-1], raw[1:]].mean()) if n > 1 else 0.0,
        covered / n,
        float(low.count("/")),
        float("://" in stem or stem.endswith("/") or "\\" in stem or re.match(rb"\.[a-z]{2,4}\b", after) is not None),
        float(bool(re.search(r"[\"'`]$", left)) and after[:1] in (b'"', b"'", b"`")),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", left)) or bool(re.search(r"=>\s*[\"'`]?$", left))),
        float(sum(said)),
        float(max(said, default=0.0)),
        float(min(reach, default=20)),
        float(re.fullmatch(r"[0-9a-f-]+", low) is not None),
        float(found.isdigit()),
        len(set(low)) / n,
        float(max((len(x) for x in re.findall(r"\d+", low)), default=0)),
    ]


def _runs(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of each candidate of the first form."""
    starts, ends, first = split_words(data, at, _CHARS[data])
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    some = ends - starts >= MIN_LENGTH
    starts, ends, row = starts[some], ends[some], row[some]
    if not len(starts):
        return
    sums = {name: np.concatenate([[0], np.cumsum(kind[data])]) for name, kind in (("d", _DIGITS), ("u", _UPPER), ("l", _LOWER))}
    has = {name: s[ends] - s[starts + (name == "u")] for name, s in sums.items()}
    ok = (has["d"] > 0) | ((ends - starts >= MIXED_LENGTH) & (has["u"] > 0) & (has["l"] > 0))
    yield from zip(row[ok].tolist(), starts[ok].tolist(), ends[ok].tolist(), strict=True)


_ASSIGN = re.compile(rb":=|=>|={1,3}|:")
_VALUE = re.compile(rb"[ \t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|`([^`\r\n]+)`|[\"'`]?([^\s\"'`]+))")
_NAME_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def _assigned(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each value that is assigned to a name with a word of FOR, from left to right; none begins inside another."""
    at = 0
    while m := _ASSIGN.search(text, at):
        at, end = m.end(), m.start()
        while end and text[end - 1] in b" \t":
            end -= 1
        if end and text[end - 1] in b"\"'`":
            end -= 1
        start = end
        while start and text[start - 1] in _NAME_BYTES:
            start -= 1
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text[start:end].decode("ascii")).lower()
        if any(w in FOR for w in re.findall(r"[a-z0-9]+", name)) and (v := _VALUE.match(text, m.end())):
            yield v.span(v.lastindex)
            at = v.end()


def _candidates(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of each candidate of either form."""
    found = set(_runs(data, at))
    for row in range(len(at) - 1):
        first = int(at[row])
        found.update((row, first + a, first + b) for a, b in _assigned(data[first : at[row + 1]].tobytes()))
    yield from sorted(found)


def _scan(batches: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    model = handle.value
    for batch in batches:
        out = []
        for first, _, data, at in text_chunks(batch.column("text")):
            for row, a, b in _candidates(data, at):
                lo, hi = max(at[row], a - AROUND), min(at[row + 1], b + AROUND)
                found = data[a:b].tobytes()
                out.append((batch.column("doc_id")[first + row].as_py(), a - at[row], b - at[row], hashlib.sha256(found).hexdigest(), _features(data[lo:a].tobytes(), found, data[b:hi].tobytes(), model)))
        if out:
            doc, a, b, sha, features = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("doc_id").type), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string()), *(pa.array([f[k] for f in features], pa.float64()) for k in range(len(NAMES)))], names=["doc_id", "start", "end", "sha256", *NAMES])


PAIRS, WORDS = 0, 1
_COUNTED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def _counted(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNTED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte pairs of the texts, and for each word the number of documents, by part of the texts."""
    sums = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, _, data, at in text_chunks(batch.column("text")):
            inside = np.ones(max(len(data) - 1, 0), bool)
            inside[at[(at > 0) & (at < len(data))] - 1] = False
            sums += np.bincount((data[:-1].astype(np.int32) * 256 + data[1:])[inside], minlength=1 << 16)
            starts, ends, first = split_words(data, at, _LETTERS[data])
            some = ends - starts >= WORD_LETTERS
            words, row = word_hashes(WORD_BYTES[data], starts[some], ends[some]), rows_of(first)[some]
            _, once = np.unique(mix(words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            found, docs = np.unique(words[once], return_counts=True)
            yield _counted(WORDS, found.view(np.int64), docs)
    some = np.flatnonzero(sums)
    yield _counted(PAIRS, some, sums[some])


def corpus_tables(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(log2 of the share of each byte pair among the pairs with the same first byte, 256 x 256; a bit for each word of the corpus'
    dictionary, by its hash, in bytes), in one pass over all texts."""
    texts = docs.select(F.col(text_col).alias("text"))
    seen = texts.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    # Words of one in WORD_SHARE documents: at most WORD_SHARE times the mean number of distinct words of a document.
    told = seen.where((F.col("kind") == PAIRS) | (F.col("n") * WORD_SHARE >= texts.count())).toArrow()
    kind, key, n = (told[c].to_numpy() for c in ("kind", "key", "n"))
    counts = np.ones(1 << 16)
    counts[key[kind == PAIRS]] += n[kind == PAIRS]
    counts = counts.reshape(256, 256)
    bits = np.zeros(1 << WORD_BITS, bool)
    bits[_bits(key[kind == WORDS].astype(np.int64).view(np.uint64))] = True
    return np.log2(counts / counts.sum(1, keepdims=True)), np.packbits(bits, bitorder="little")


def learn_neighbours(findings: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """For each word beside a finding the logarithm of its odds to stand beside a secret."""
    beside = (Counter(), Counter())
    for before, _, after, label in findings:
        beside[label].update(set(neighbours(before.encode()[-AROUND:], after.encode()[:AROUND])[1]))
    totals = [1 + sum(label == k for *_, label in findings) for k in (0, 1)]
    odds = {w: float(np.log((beside[1][w] + 2) / totals[1]) - np.log((beside[0][w] + 2) / totals[0])) for w in beside[0] | beside[1]}
    # Words of a few findings say nothing.
    return {w: x for w, x in odds.items() if beside[0][w] + beside[1][w] >= 5}


def learn_model(docs: DataFrame, findings: list[tuple[str, str, str, int]], text_col: str = "text") -> Model:
    return Model(*corpus_tables(docs, text_col), learn_neighbours(findings))


def labelled_findings(n: int = FINDINGS, seed: int = 0) -> list[tuple[str, str, str, int]]:
    """n findings (before, candidate, after, label), half of them secrets, and n // 4 more of assigned values in any alphabet and length."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choices(chars, k=k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = ("an", "the", "re", "tion", "er", "or", "st", "in", "ou", "de", "que", "ich", "mente", "ung", "ar", "le")
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 3)))
    filler = lambda: " ".join(word() for _ in range(rnd.randint(2, 6)))
    b64 = lambda k: base64.b64encode(rnd.randbytes(k)).decode()

    def secret() -> str:
        return rnd.choice((lambda: pick(hexa, rnd.choice((32, 40, 64))), lambda: pick(alnum, rnd.randint(20, 44)), lambda: b64(rnd.randint(18, 40)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: f"xoxb-{pick(string.digits, 11)}-{pick(alnum, 24)}", lambda: pick(alnum + "-_", rnd.randint(14, 24)) + rnd.choice(string.digits)))()

    def harmless() -> tuple[str, str, str]:
        plain = (filler() + " ", " " + filler())
        kind = rnd.randrange(9)
        if kind == 0:
            return f"{filler()} {rnd.choice(AGAINST[:9])} {rnd.choice(('', '= ', ': '))}", pick(hexa, rnd.choice((32, 40, 64))), " " + filler()
        if kind == 1:
            return plain[0], pick(string.digits, rnd.choice((12, 13, 16, 16, 19))), plain[1]
        if kind == 2:
            return f"{filler()} {rnd.choice(('id', 'uuid', 'guid'))} ", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), plain[1]
        if kind == 3:
            return f"{filler()} https://{word()}.example.com/", "/".join(word() for _ in range(rnd.randint(2, 4))) + "/" + pick(string.digits, rnd.randint(2, 6)), rnd.choice((".html", " ", "?page=2"))
        if kind == 4:
            return plain[0], "".join(w.capitalize() for w in rnd.sample(KNOWN, 3)) + rnd.choice(("", "2", "Test1")), plain[1]
        if kind == 5:
            return f"{filler()} {rnd.choice(FOR[:7])} = \"", rnd.choice(("your_api_key_here1", "xxxxxxxxxxxxxxxx1234", "example_token_123", "changeme_password_1", "replace-with-value-0", "0000000000000000", "test_token_value_42")), '" ' + filler()
        if kind == 6:
            return plain[0], "_".join(word() for _ in range(3)) + pick(string.digits, 2), plain[1]
        if kind == 7:
            return plain[0], f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}-{word()}-{word()}", plain[1]
        return plain[0], "".join(word() for _ in range(5)) + "=" * rnd.randint(0, 2) + pick(string.digits, 1), plain[1]

    out = []
    for k in range(n):
        if k % 2:
            out.append((*harmless(), 0))
        else:
            quote = rnd.choice(('"', "'", ""))
            name = rnd.choice((*FOR, "api_key", "client_secret", "AUTH_TOKEN", "access_key"))
            out.append((f"{filler()} {name}{rnd.choice((' = ', '=', ': ', ' '))}{quote}", secret(), quote + " " + filler(), 1))
    symbols = "@!#$%.:^&*?"
    passwords = (lambda: pick(string.ascii_lowercase, rnd.randint(5, 24)), lambda: pick(string.ascii_letters, rnd.randint(6, 19)), lambda: pick(alnum, rnd.randint(5, 11)), lambda: pick(alnum + symbols, rnd.randint(6, 24)), lambda: word().capitalize() + pick(symbols, 1) + pick(string.digits, rnd.randint(2, 4)), lambda: f"{pick(alnum, 3)}{rnd.choice(symbols)}{pick(alnum, rnd.randint(3, 9))}!{pick(string.digits, 4)}")
    fixed = ("true", "false", "null", "None", "required", "string", "str", "your_password", "yourpassword", "changeme", "example", "password", "passwords", "value", "token", "undefined", "optional", "placeholder", "********", "xxxxxxxx", "<password>", "<your-token>", "${PASSWORD}", "$TOKEN", "{{ secret }}", "%s", "...", "config.password", "settings.api_key,", "os.environ['TOKEN']", "process.env.SECRET", "getpass.getpass()", "request.token", "user", "id", "name", "a", "the", "is", "to")
    for k in range(n // 4):
        quote = rnd.choice(('"', "'", ""))
        name = rnd.choice((*FOR, "api_key", "client_secret", "AUTH_TOKEN", "db_password"))
        out.append((f"{filler()} {name}{rnd.choice((' = ', '=', ': ', ':', ' => '))}{quote}", rnd.choice(passwords)() if k % 2 == 0 else rnd.choice(fixed), quote + " " + filler(), 1 - k % 2))
    return out


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, int]], model: Model, seed: int = 7):
    rows = [(*_features(b.encode()[-AROUND:], c.encode(), a.encode()[:AROUND], model), float(y)) for b, c, a, y in findings]
    # One partition, so that the samples of the trees are the same on any cluster.
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*NAMES, "label"))).coalesce(1)
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(frame).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(vectors)


def scan_secrets(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, start, end, sha256 (of the candidate, which is not shown), probability, is_secret."""
    spark = docs.sparkSession
    findings = labelled_findings() if findings is None else findings
    model = learn_model(docs, findings, text_col)
    forest = train_forest(spark, findings, model)
    handle = spark.sparkContext.broadcast(model)
    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, end long, sha256 string, " + ", ".join(f"{c} double" for c in NAMES)
    found = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).mapInArrow(lambda x: _scan(x, handle), kind)
    judged = forest.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(found))
    return judged.select("doc_id", "start", "end", "sha256", vector_to_array("probability")[1].alias("probability")).withColumn("is_secret", F.col("probability") >= least)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"))
