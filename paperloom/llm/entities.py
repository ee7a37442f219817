"""Variant spellings of names linked to the entity they mean.

Names are parsed into a key, given names, line-of-business words, legal form and town; the
distinct keys (not the records) are banded by MinHash over padded q-grams, with the number
of bands read off the collision curve for a wanted recall; pairs that meet are verified by
a Monge-Elkan similarity over the parts; and stars are formed around centres: registered
names, and names that are themselves common where a misspelling would be rare.  A record
takes the centre of its star.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import checkpointed

#: Padded q-grams, rows of a band, and the recall wanted at about the least similarity of
#: keys that monge_elkan() accepts (two swaps in 11 letters have 0.33).
Q, BAND_ROWS, AT_SIMILARITY, RECALL = 2, 2, 0.3, 0.975
#: A name that is no registered one is its own centre from so many records, and from this
#: share of the records of the centre it resembles.
OWN_COUNT, OWN_SHARE = 3, 0.2
#: Edits that two keys may differ by, as a share of the longer one.
MOST_EDITS = 0.34
#: Tasks that the records of one name are spread over where links meet records.
SALTS = 16

# Legal forms, long and short.
LEGAL = {
    "company": "co", "limited": "ltd", "incorporated": "inc", "corporation": "corp", "aktiebolag": "ab", "co": "co", "ltd": "ltd", "inc": "inc", "corp": "corp", "ab": "ab", "gmbh": "gmbh", "plc": "plc",
    "llc": "llc", "sarl": "sarl", "sa": "sa", "ag": "ag", "bv": "bv", "oy": "oy", "as": "as", "kg": "kg", "spa": "spa", "srl": "srl", "pty": "pty", "lp": "lp", "llp": "llp",
}
# Short forms of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex al sandy xander", "alexandra": "alex sandra lexi", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny", "catherine": "cathy kate cat", "charles": "charlie chuck chas",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothea": "dot dottie dora dorothy thea", "edward": "ed eddie ted ned", "elizabeth": "liz lizzie beth betty eliza betsy libby lisa", "frederick": "fred freddie freddy rick",
    "gregory": "greg", "henry": "harry hank", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie joey fina", "joshua": "josh", "katherine": "kate kathy katie kat kit kay kitty",
    "lawrence": "larry laurie lars", "margaret": "meg maggie peggy marge greta margie", "matthew": "matt", "michael": "mike mick mickey micky", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "patricia": "pat patty trish", "peter": "pete", "philip": "phil", "rebecca": "becky becca",
    "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron", "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie suzy sukie anna susan", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vic vickie", "william": "will bill billy liam willie",
}
_BRANCH = re.compile(r"#\s*\d+|\((?:branch|filiale|store|shop|no\.?)\s*\d+\)|\b(?:branch|filiale|store no\.?|shop)\s+\d+\b|\s\d+\s*$", re.I)
_SEED = np.random.default_rng(20240611)
_HASHES = 256
_A, _B = _SEED.integers(1, 1 << 61, _HASHES, dtype=np.uint64) | np.uint64(1), _SEED.integers(0, 1 << 61, _HASHES, dtype=np.uint64)


def bands_for(similarity: float = AT_SIMILARITY, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Bands needed so that a pair of that similarity meets with that probability: the
    least b with 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def plain(text: str) -> str:
    folded = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l"))
    return "".join(c for c in folded if not unicodedata.combining(c))


def damerau(a: str, b: str, most: int = 99) -> int:
    """Edits (with neighbours swapped as one) between two strings, given up beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def abbreviates(short: str, word: str) -> bool:
    """Manuf, Mfg, Labs, Dept, Int'l: a beginning, or the consonants, or both ends."""
    if short == word:
        return True
    if len(short) < 3 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short) or short[-1] in "s" + word[-1] and len(short) >= 3 and word.startswith(short[:-1]) and len(short) > 3:
        return True
    bones = word[0] + re.sub("[aeiou]", "", word[1:])
    if re.search("[aeiou]", short[1:]):
        return False
    if bones.startswith(short):
        return True
    if short[-1] != bones[-1]:
        return False
    rest = iter(bones)
    return all(c in rest for c in short)


class Vocabulary:
    """Words of the register that are no keys: lines of business, towns, given names."""

    def __init__(self, names: list[tuple[int, str, str, str]]):
        self.business: set[str] = set()
        self.given: dict[str, str] = {}
        self.towns: set[str] = set()
        for _, kind, name, town in names:
            words = [w for w in re.split(r"[^\w]+", plain(name or "")) if w]
            if kind == "person":
                for w in words[:-1]:
                    self.given[w] = w
            else:
                self.business.update(w for w in words[1:] if w not in LEGAL)
            self.towns.update(re.split(r"[^\w]+", plain(town or "")))
        self.towns.discard("")
        for full, shorts in NICKNAMES.items():
            self.given.setdefault(full, full)
            for w in shorts.split():  # a short form may stand for several names
                self.given[w] = f"{self.given[w]}|{full}" if w in self.given else full
        kinds = ((self.business, "business"), (set(LEGAL), "legal"), (set(self.given), "given"), (self.towns, "town"))
        self.fuzzy = [([(k, set(k)) for k in sorted(known) if len(k) >= 5], what) for known, what in kinds]
        self.seen: dict[str, tuple[str, str]] = {}

    def kind_of(self, word: str) -> tuple[str, str]:
        """('legal' | 'business' | 'town' | 'given' | 'initial' | 'key', canonical word)."""
        if word not in self.seen:
            if len(self.seen) > 400_000:
                self.seen.clear()
            self.seen[word] = self._kind_of(word)
        return self.seen[word]

    def _kind_of(self, word: str) -> tuple[str, str]:
        if word in LEGAL:
            return "legal", LEGAL[word]
        if word in self.business:
            return "business", word
        if word in self.towns:
            return "town", word
        if word in self.given:
            return "given", self.given[word]
        if len(word) == 1:
            return "initial", word
        short = sorted(b for b in self.business if abbreviates(word, b))
        if short:
            return "business", short[0] if len(short) == 1 else "|".join(short)
        letters, most = set(word), 1 if len(word) < 8 else 2
        for known, what in self.fuzzy:
            if len(word) >= 6:
                # An edit changes the set of letters by two at most.
                near = [(damerau(word, k, most), k) for k, own in known if abs(len(k) - len(word)) <= most and len(letters ^ own) <= 2 * most]
                near = [n for n in near if n[0] <= most]
                if near:
                    best = min(near)[1]
                    return what, LEGAL.get(best, self.given.get(best, best)) if what != "business" else best
        return "key", word

    def parse(self, name: str) -> tuple[str, str, str, str, str]:
        """(key, given, business, legal, town) of a written name; the last four as words
        with blanks between."""
        text = _BRANCH.sub(" ", unicodedata.normalize("NFKC", name))
        text = plain(text).replace("'", "").replace("’", "")
        text = re.sub(r"\b((?:\w\.){2,}\w?)", lambda m: m[0].replace(".", ""), text)
        text = re.sub(r"(?<=\w)[-‐‑](?=\w)", "", text)
        parts: dict[str, list[str]] = {k: [] for k in ("key", "given", "business", "legal", "town", "initial")}
        words = [w for w in re.split(r"[^\w]+", text) if w and not w.isdigit()]
        for i, word in enumerate(words):
            what, canon = self.kind_of(word)
            if word == "st" and i and words[i - 1].startswith("dep"):
                what, canon = "business", "store"
            if what == "town" and i == 0:
                what, canon = "key", word
            if i and i == len(words) - 1 and what in ("key", "initial") and len(word) <= 3 and parts["key"] and not parts["given"] and not parts["business"]:
                cut_off = sorted(b for b in self.business if b.startswith(word))  # the name's end was cut off
                if cut_off:
                    what, canon = "business", "|".join(cut_off)
            parts[what].append(canon)
        given = parts["given"] + parts["initial"]
        return "".join(parts["key"]), " ".join(given), " ".join(parts["business"]), " ".join(parts["legal"][:1]), " ".join(parts["town"])


def _business_fits(a: str, b: str) -> bool:
    return all(any(set(w.split("|")) & {x} for x in b.split()) for w in a.split())


def _given_fits(a: str, b: str) -> bool:
    """Each given name or initial of ``a`` has its own in ``b``."""
    left = b.split()
    for word in a.split():
        means = set(word.split("|"))
        hit = next((x for x in left if set(x.split("|")) & means or len(word) == 1 and x[0] == word or len(x) == 1 and x == word[0]), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def key_edits(a: str, b: str) -> int | None:
    """Edits between two keys, or None beyond a third of the longer one."""
    most = max(1, int(max(len(a), len(b)) * MOST_EDITS))
    edits = damerau(a, b, most)
    return edits if edits <= most else None


def letters_agree(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Whether the letters of two keys are so much alike that few edits can part them: an edit
    changes the counts of two letters at most, a swap none."""
    def bags(keys: pd.Series) -> np.ndarray:
        lengths = keys.str.len().to_numpy(np.int64)
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32) % 64
        rows = np.repeat(np.arange(len(keys)), lengths)
        return np.bincount(rows * 64 + codes, minlength=64 * len(keys)).reshape(-1, 64)

    most = np.maximum(1, (np.maximum(a.str.len(), b.str.len()).to_numpy() * MOST_EDITS).astype(np.int64))
    return np.abs(bags(a) - bags(b)).sum(axis=1) <= 2 * most


def monge_elkan(a: tuple[str, str, str, str, str], b: tuple[str, str, str, str, str]) -> float:
    """Mean over the parts of the written name ``a`` of their best match in ``b``, each part
    weighted by how much it tells; 0 where a part contradicts."""
    if not a[0] or not b[0]:
        return 0.0
    edits = key_edits(a[0], b[0])
    if edits is None:
        return 0.0
    key = 1 - edits / max(len(a[0]), len(b[0]))
    weights, total = 3.0, 3.0 * key
    if a[1]:
        if not b[1] or not _given_fits(a[1], b[1]):
            return 0.0
        weights, total = weights + 1.5, total + 1.5
    elif b[1]:
        return 0.0 if key < 1 else 0.6
    if a[2]:
        if not _business_fits(a[2], b[2]):
            return 0.0
        weights, total = weights + 1.5, total + 1.5
    if a[3]:
        if a[3] != b[3]:
            return 0.0
        weights, total = weights + 1.0, total + 1.0
    support = (1 if a[1] or a[2] else 0) + (1 if a[3] or a[1] else 0)
    least = (0.88, 0.8, 0.68)[support]
    return total / weights if key >= least else 0.0


def signature(key: str) -> np.ndarray:
    """MinHash values of a key's padded q-grams."""
    padded = "^" * (Q - 1) + key + "$" * (Q - 1)
    grams = np.fromiter({xxhash.xxh64_intdigest(padded[i:i + Q]) for i in range(len(padded) - Q + 1)}, np.uint64)
    return (grams[:, None] * _A + _B).min(axis=0)


def _banded(keys: DataFrame, key: str) -> DataFrame:
    """``key, band`` of each distinct key."""
    bands = bands_for()
    assert bands * BAND_ROWS <= _HASHES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch[key]:
                values = signature(k)[: bands * BAND_ROWS].reshape(bands, BAND_ROWS)
                out.append([xxhash.xxh64_intdigest(row.tobytes(), seed=n) - (1 << 63) for n, row in enumerate(values)])
            if out:
                yield pd.DataFrame({key: batch[key], "bands": out})

    kept = keys.mapInPandas(run, f"`{key}` string, bands array<bigint>")
    return kept.select(key, F.explode("bands").alias("band"))


def link_names(records: DataFrame, name: str, register: DataFrame) -> DataFrame:
    """``records`` with ``org_id`` (null where its name means nobody of the register).

    ``register`` has ``org_id, org_kind, registered_name, town``; it is a reference list of
    fixed size, read on the driver for its vocabulary.  Null, empty and placeholder names
    have no org_id; where a name means several registered ones equally well (a shared key and
    nothing else to tell, not even the town), none is given.  Every record comes out once.
    """
    spark = records.sparkSession
    listed = [tuple(r) for r in register.select("org_id", "org_kind", "registered_name", "town").where("org_id is not null and registered_name is not null").dropDuplicates(["org_id"]).orderBy("org_id").toLocalIterator()]
    words = Vocabulary(listed)
    parse_schema = "key string, given string, business string, legal string, town string"

    @F.pandas_udf(parse_schema)
    def parsed(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([words.parse(n) for n in names], columns=["key", "given", "business", "legal", "town"])

    # One row per distinct spelling; what follows never sees the records again.
    spelled = records.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("n")).where("_name is not null")
    spelled = checkpointed(spelled.withColumn("p", parsed("_name")).select("_name", "n", "p.*"))
    orgs = spark.createDataFrame(listed, "org_id bigint, org_kind string, registered_name string, org_town string")
    orgs = orgs.withColumn("p", parsed("registered_name")).select("org_id", "registered_name", F.lower("org_town").alias("org_town"), F.col("p.key").alias("o_key"), F.col("p.given").alias("o_given"), F.col("p.business").alias("o_business"), F.col("p.legal").alias("o_legal"))

    counts = spelled.where("key <> ''").groupBy("key").agg(F.sum("n").alias("key_n"))
    centre_keys = orgs.select("o_key").where("o_key <> ''").distinct()
    met = _banded(counts.select("key"), "key").join(_banded(centre_keys, "o_key"), "band").select("key", "o_key").distinct()

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        close = letters_agree(a, b)
        close[close] = [key_edits(x, y) is not None for x, y in zip(a[close], b[close])]
        return pd.Series(close)

    # Keys too far apart can make no link; they go before the forms of a key are joined.
    reach = F.greatest(F.lit(1), F.floor(F.greatest(F.length("key"), F.length("o_key")) * MOST_EDITS))
    met = met.where(F.abs(F.length("key") - F.length("o_key")) <= reach).where(near("key", "o_key"))
    forms = spelled.where("key <> ''").select("key", "given", "business", "legal", "town").distinct()
    pairs = met.join(orgs, "o_key").join(forms, "key").join(counts, "key")
    pairs = pairs.join(counts.select(F.col("key").alias("o_key"), F.col("key_n").alias("o_n")), "o_key", "left")

    @F.pandas_udf("double")
    def similar(k: pd.Series, g: pd.Series, b: pd.Series, le: pd.Series, ok: pd.Series, og: pd.Series, ob: pd.Series, ol: pd.Series) -> pd.Series:
        return pd.Series([monge_elkan(tuple(x[:4]) + ("",), tuple(x[4:]) + ("",)) for x in zip(k, g, b, le, ok, og, ob, ol)], dtype="float64")

    scored = pairs.withColumn("score", similar("key", "given", "business", "legal", "o_key", "o_given", "o_business", "o_legal")).where("score > 0")
    # A spelling that is common by itself is a centre of its own, not a misspelling.
    own = (F.col("key") != F.col("o_key")) & (F.col("key_n") >= OWN_COUNT) & (F.col("key_n") >= OWN_SHARE * F.coalesce("o_n", F.lit(0)))
    scored = scored.where(~own).withColumn("in_town", (F.col("town") != "") & (F.col("town") == F.col("org_town")))
    form = ["key", "given", "business", "legal", "town"]
    ranked = scored.withColumn("_best", F.max(F.struct("score", "in_town")).over(Window.partitionBy(*form))).where(F.struct("score", "in_town") == F.col("_best"))
    linked = ranked.groupBy(*form).agg(F.count("*").alias("ties"), F.min("org_id").alias("org_id")).where("ties = 1").drop("ties")
    # A name may stand in a third of all records: its rows go to SALTS tasks, and those without
    # a name to none of them.
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    named = spelled.join(linked, form).select("_name", "org_id").withColumn("_salt", salts)
    written = records.where(F.col(name).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*records.columns), F.lit(SALTS)).cast("int"))
    found = written.join(named, (F.col(name) == F.col("_name")) & (written["_salt"] == named["_salt"]), "left").select(*[written[c] for c in records.columns], "org_id")
    return found.unionByName(records.where(F.col(name).isNull()).withColumn("org_id", F.lit(None).cast("bigint")))
