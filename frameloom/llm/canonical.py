"""Mapping freely typed values to a canonical list; unmatched values are reported.

The distinct values are matched, never the rows. Every lookup walks a BK-tree over
the unrestricted Damerau-Levenshtein distance, a true metric, so that the
triangle inequality prunes the tree without losing an entry. What differs is the
threshold: a designation (prefix and number) must agree exactly, so its threshold
is 0; a whole name is tried with 0 first, then with the errors that its length
tolerates.

Reference lists up to `shard_size` keys form one broadcast set of trees; larger
ones are split into shards whose winners are merged. Both give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that are also typed as two.
SPELLED_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa", "œ": "oe"}
# Greek letters in names.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta"}


def plain(text: str) -> str:
    """Lower case, no accents, separators as single blanks."""
    s = unicodedata.normalize("NFKC", text).casefold()
    s = "".join(SPELLED_OUT.get(c, GREEK.get(c, c)) for c in s)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"[\s_\-./]+", " ", s).strip()


def edit_distance(a: str, b: str, limit: int = 1 << 30) -> int:
    """Unrestricted Damerau-Levenshtein distance (a metric); limit + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    big = len(a) + len(b)
    last: dict[str, int] = {}
    h = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        # Places further than the limit off the diagonal cost more than the limit.
        lo, hi = max(1, i - limit), min(len(b), i + limit)
        col = b.rfind(a[i - 1], 0, lo - 1) + 1
        for j in range(lo, hi + 1):
            k, m = last.get(b[j - 1], 0), col
            cost = a[i - 1] != b[j - 1]
            if not cost:
                col = j
            h[i + 1][j + 1] = min(
                h[i][j] + cost, h[i + 1][j] + 1, h[i][j + 1] + 1, h[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        last[a[i - 1]] = i
    return min(h[-1][-1], limit + 1)


class BKTree:
    """Every key within a radius of a query, by triangle-inequality pruning."""

    def __init__(self, keys: Iterable[str], metric: Callable[..., int] = edit_distance):
        self.metric, self.root = metric, None
        for key in keys:
            self.add(key)

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while True:
            d = self.metric(key, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            key, children = stack.pop()
            # Beyond this distance neither the node nor a child of it is within the radius.
            d = self.metric(query, key, radius + max(children, default=0))
            if d <= radius:
                found.append((d, key))
            stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return sorted(found)


class Index:
    """Entries by key, found through a BK-tree of the keys."""

    def __init__(self, entries: dict[str, set]):
        self.entries, self.tree = entries, BKTree(sorted(entries))

    def within(self, query: str, radius: int) -> list[tuple[int, set]]:
        """(distance, entries) of every key within the radius."""
        return [(d, self.entries[key]) for d, key in self.tree.within(query, radius)]

    def at(self, query: str) -> set:
        """Entries at distance 0; an empty set for none."""
        return next((refs for _, refs in self.within(query, 0)), set())


def radius_of(text: str) -> int:
    """Typing errors tolerated in a name: one from 4 letters, two from 6."""
    return 0 if len(text) < 4 else 1 if len(text) < 6 else 2


class NameMatcher:
    """Matches values to reference entries given as (ref_id, name) or (ref_id, name, whole).

    whole            the name is a further spelling that is matched as a whole, without errors.
    words_are_types  the last word of a name that several entries share is a kind
                     (`Nebula`); it may be left out or cut short, but not contradict.
    noise            pattern removed from the normal form of values and names.
    learned          (kinds, prefixes, pairs of prefixes of one catalogue) of all names where pairs are
                     a part of them; otherwise learned from pairs.
    """

    def __init__(
        self,
        pairs: list[tuple],
        designations: bool = True,
        words_are_types: bool = True,
        noise: str | None = None,
        learned: tuple[set[str], set[str], set[tuple[str, str]]] | None = None,
    ):
        self.noise = re.compile(noise) if noise else None
        self.designations = designations
        whole: dict[str, set[int]] = defaultdict(set)
        numbers: dict[str, set[int]] = defaultdict(set)
        names: list[tuple[int, str]] = []
        prefixes: dict[str, set[tuple[int, str]]] = defaultdict(set)
        for ref, name, *flag in pairs:
            for part in {name, re.sub(r"\([^)]*\)", " ", name)}:
                key = self.normal(part)
                if key:
                    whole[key.replace(" ", "")].add(ref)
            if any(flag):
                continue
            for prefix, number in self.designators(name) if designations else []:
                numbers[f"{prefix} {number}"].add(ref)
                prefixes[prefix].add((ref, number))
            if (bare := self.bare(name)) is not None:
                names.append((ref, bare))
        if learned is None:
            # Two prefixes that share their numbers in several entries name one catalogue.
            alike = {(a, b) for a, x in prefixes.items() for b, y in prefixes.items() if a != b and len(x & y) >= 2}
            ends = defaultdict(set)
            for ref, name in names:
                words = name.split(" ")
                if len(words) > 1:
                    ends[words[-1]].add(ref)
            learned = {w for w, refs in ends.items() if words_are_types and len(refs) >= 2}, set(prefixes), alike
        self.kinds, self.prefixes, self.alike = learned
        # Head of a name -> entries with the kinds they were named with.
        heads: dict[str, set[tuple[int, str]]] = defaultdict(set)
        for ref, name in names:
            head, kind = self.split_kind(name)
            heads[head.replace(" ", "")].add((ref, kind))
        self.numbers, self.whole, self.heads = Index(numbers), Index(whole), Index(heads)

    def normal(self, text: str) -> str:
        s = plain(text)
        if self.noise:
            s = re.sub(r"\s+", " ", self.noise.sub(" ", s)).strip()
        return s

    def bare(self, name: str) -> str | None:
        """Normal form of a name of the list that is matched by distance."""
        bare = self.normal(re.sub(r"\([^)]*\)", " ", name))
        return re.sub(r"^name ", "", bare) if bare and not (self.designations and self.designators(bare)) and "," not in name else None

    @staticmethod
    def designators(text: str) -> list[tuple[str, str]]:
        s = unicodedata.normalize("NFKC", text).casefold()
        return [(p, n.lstrip("0") or "0") for p, n in re.findall(r"(?<![^\W\d_])([^\W\d_]{1,8})[\s._#\-]*(\d+)(?!\d|\.\d)", s)]

    def split_kind(self, name: str) -> tuple[str, str]:
        """Head and kind of a name; the kind may have a qualifier in front (`dark nebula`)."""
        words = name.split(" ")
        cut = len(words)
        while cut > 1 and (words[cut - 1] in self.kinds or (cut < len(words) and words[cut - 1] in {"dark"})):
            cut -= 1
        return " ".join(words[:cut]), " ".join(words[cut:])

    def by_number(self, text: str) -> tuple[bool, tuple[int, int], set[int]]:
        """Whether the value is a designation of a catalogue of the list, the place of the one found, and its entries."""
        asked = False
        for i, (prefix, number) in enumerate(self.designators(text)):
            if prefix not in self.prefixes:
                continue
            asked = True
            for j, p in enumerate([prefix, *sorted(b for a, b in self.alike if a == prefix)]):
                if refs := self.numbers.at(f"{p} {number}"):
                    return True, (i, j), refs
        return asked, (0, 0), set()

    def by_name(self, text: str, swapped: int = 1) -> tuple[tuple[int, int, int], set[int]]:
        """Rank and entries of the closest name: words swapped at a comma first, then whole names, then the distance."""
        s = re.sub(r"[(\[{][^)\]}]*[)\]}]", " ", text) if not re.fullmatch(r"\s*[(\[{].*[)\]}]\s*", text) else text.strip(" ()[]{}")
        if m := re.fullmatch(r"\s*([^,]+),\s*([^,]+)\s*", s):
            if (hit := self.by_name(f"{m[2]} {m[1]}", 0))[1]:
                return hit
        key = re.sub(r"^(the|name|der|die|das) ", "", self.normal(s))
        compact = key.replace(" ", "")
        if not compact:
            return (2, 0, 0), set()
        if refs := self.whole.at(compact):
            return (swapped, 0, 0), refs
        best: dict[int, int] = {}
        for head, kind in self.readings(key):
            for d, entries in self.heads.within(head, radius_of(head)):
                for ref, own in entries:
                    if self.agree(kind, own):
                        best[ref] = min(d, best.get(ref, 99))
        if not best:
            return (2, 0, 0), set()
        d = min(best.values())
        return (swapped, 1, d), {r for r, x in best.items() if x == d}

    def readings(self, key: str) -> list[tuple[str, str]]:
        """Ways to read a value as head and kind: all head, kind split off, kind run on."""
        words, out = key.split(" "), [(key.replace(" ", ""), "")]
        out += [("".join(words[:i]), " ".join(words[i:])) for i in range(1, len(words))]
        if len(words) == 1:
            out += [(key[: -len(k)], k) for k in self.kinds if key.endswith(k) and len(key) > len(k) + 2]
        return out

    @staticmethod
    def agree(kind: str, own: str) -> bool:
        """A stated kind is the entry's, misspelled or cut short."""
        if not kind or kind == own:
            return True
        if not own:
            return False
        a, b = kind.replace(" ", ""), own.replace(" ", "")
        if len(a) >= 2 and b.startswith(a):
            return True
        return len(a) >= 4 and edit_distance(a, b, 2) <= radius_of(b)

    def find(self, text: str) -> tuple[tuple[int, int, int, int], set[int]]:
        """Rank of the best hits and their entries: designations, unknown ones, names, nothing."""
        asked, place, refs = self.by_number(text) if self.designations else (False, (0, 0), set())
        if asked:
            return (0, *place, 0) if refs else (1, 0, 0, 0), refs
        rank, refs = self.by_name(text)
        return (2, *rank) if refs else (3, 0, 0, 0), refs

    def match(self, text: str) -> tuple[int | None, int | None, str]:
        """(ref_id, distance, how); ref_id is None if nothing, or more than one entry, fits."""
        (step, *_, d), refs = self.find(text)
        if len(refs) == 1:
            return next(iter(refs)), d, "number" if step == 0 else "exact" if d == 0 else "fuzzy"
        return None, d if refs else None, "ambiguous" if refs else "unknown_number" if step == 1 else "unmatched"


def _learn(names: DataFrame, settings: dict) -> tuple[set[str], set[str], set[tuple[str, str]]]:
    """What NameMatcher learns from names (ref_id, name), as one matcher of all of them would. Collects the vocabulary only."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = NameMatcher([], **settings)
        for pdf in batches:
            out = []
            pdf = pdf[~pdf["whole"]]
            for ref, name in zip(pdf["ref_id"].tolist(), pdf["name"]):
                out += [(ref, p, n) for p, n in m.designators(name)] if m.designations else []
                if settings["words_are_types"] and " " in (bare := m.bare(name) or ""):
                    out.append((ref, bare.split(" ")[-1], None))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(("ref_id", "word", "number"))})

    got = names.mapInPandas(words, "ref_id bigint, word string, number string").distinct()
    kinds = got.where("number is null").groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    used = got.where("number is not null")
    other = used.select("ref_id", "number", F.col("word").alias("other"))
    alike = used.join(other, ["ref_id", "number"]).where("word <> other").groupBy("word", "other").agg(F.count("*").alias("n")).where("n >= 2")
    return {r.word for r in kinds.collect()}, {r.word for r in used.select("word").distinct().collect()}, {(r.word, r.other) for r in alike.collect()}


#: Values that one task of the sharded path matches against a shard.
VALUES_A_TASK = 50_000


def canonicalise(
    values: DataFrame,
    reference: DataFrame,
    value: str,
    designations: bool = True,
    words_are_types: bool = True,
    spellings: DataFrame | None = None,
    noise: str | None = None,
    shard_size: int = 20_000,
) -> DataFrame:
    """One row per distinct value: value, ref_id (null: none meant), distance, how.

    reference  `ref_id` bigint and `name`; several names per entry.
    spellings  further spellings as a table of `name` (as in reference) and `spelling`,
               matched as whole names without errors.
    Null and blank values give no row. Ties between entries give `ambiguous`, the
    distance they tie at and no ref_id. `how` is number, exact, fuzzy, ambiguous,
    unknown_number or unmatched.

    Counts the reference first (an action): up to `shard_size` names are sent to
    the executors as trees; more are split by hash into shards, each matched
    against all values in groups of bounded size, and the best of the winners is
    kept. The result is the same: kinds and prefixes are learned from all names
    first (an action), and hits rank as the one set of trees tries them.
    """
    settings = {"designations": designations, "words_are_types": words_are_types, "noise": noise}
    names = reference.where("name is not null").select(F.col("ref_id").cast("long").alias("ref_id"), "name", F.lit(False).alias("whole"))
    if spellings is not None:
        more = names.join(spellings.where("spelling is not null").select("name", "spelling"), "name")
        names = names.unionByName(more.select("ref_id", F.col("spelling").alias("name"), F.lit(True).alias("whole")))
    names = names.distinct()
    asked = values.select(F.col(value).alias("value")).where(F.trim("value") != "").distinct()
    n = names.count()
    ranked = "value string, rank array<int>, refs array<bigint>"

    def hits(matcher: NameMatcher, texts: list[str]) -> pd.DataFrame:
        found = [matcher.find(v) for v in texts]
        # Two entries are enough to tell that it's not one.
        columns = {"value": texts, "rank": [list(h[0]) for h in found], "refs": [sorted(h[1])[:2] for h in found]}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})

    if n <= shard_size:
        pairs = [tuple(r) for r in names.sort("ref_id", "name", "whole").collect()]
        # Few values cost much each: without this the runtime would merge them into one task.
        tasks = max(2 * values.sparkSession.sparkContext.defaultParallelism, 8)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = None
            for pdf in batches:
                matcher = matcher or NameMatcher(pairs, **settings)
                yield hits(matcher, pdf["value"].tolist())

        best = asked.repartition(tasks, "value").mapInPandas(run, ranked)
    else:
        # Names of an entry stay together; salts keep a shard's values in bounded groups.
        shards, salts = -(-n // shard_size), -(-max(asked.count(), 1) // VALUES_A_TASK)
        refs = names.withColumn("shard", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).cast("int"))
        refs = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn(
            "salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")
        )
        learned = _learn(names, settings)

        def shard(vals: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
            matcher = NameMatcher(list(zip(refs["ref_id"].tolist(), refs["name"], refs["whole"])), **settings, learned=learned)
            return hits(matcher, vals["value"].tolist())

        each = queries.groupBy("shard", "salt").cogroup(refs.groupBy("shard", "salt")).applyInPandas(shard, ranked)
        tied = each.groupBy("value", "rank").agg(F.flatten(F.collect_list("refs")).alias("refs"))
        best = tied.groupBy("value").agg(F.min("rank").alias("rank"), F.min_by("refs", "rank").alias("refs"))
    one, step, d = F.size("refs") == 1, F.col("rank")[0], F.col("rank")[3]
    return best.select(
        F.col("value").alias(value),
        F.when(one, F.col("refs")[0]).alias("ref_id"),
        F.when(F.size("refs") > 0, d).alias("distance"),
        F.when(one, F.when(step == 0, "number").when(d == 0, "exact").otherwise("fuzzy"))
        .when(F.size("refs") > 1, "ambiguous").when(step == 1, "unknown_number").otherwise("unmatched").alias("how"),
    )


#: Removed from filter names: the word filter and a band width.
FILTER_NOISE = r"\b\d+( \d+)?\s*nm\b|\bfilter\b|(?<=[a-z])filter\b"


def canonical_filters(values: DataFrame, filters: DataFrame, spellings: DataFrame, value: str) -> DataFrame:
    """`canonicalise` for filter names; `filters` has filter_id and filter_name, `spellings` name and spelling."""
    ref = filters.select(F.col("filter_id").alias("ref_id"), F.col("filter_name").alias("name"))
    return canonicalise(values, ref, value, designations=False, words_are_types=False, spellings=spellings, noise=FILTER_NOISE)
