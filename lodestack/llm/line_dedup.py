"""Operator 9: fuzzy duplicate lines across documents, with DataFrame functions only.

Lines are normalised (lower case, letters only); equal normal forms are one class. Classes meet where a band of ROWS MinHash
coordinates is equal, in any of BANDS bands. Features are pairs of neighbouring words; lines of few words have runs of
characters. Classes of up to DELETED letters meet wherever they can be alike. Candidates are verified by edit similarity of
the normal forms alone; connected classes are one group, of which the first line (by document id, then place) stays.

The bands stand in for SimHash blocks, which cannot give right results here: lines of edit similarity 0.8 differ in up to a
seventh of their SimHash bits, and pigeonhole leaves blocks of seven bits for that at any code width, which every 128th line shares.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import BROADCAST_ROWS, content_key, materialize, partitions, small, unused
from lodestack.llm.components import components

BANDS = 8
ROWS = 3
#: Words from which a line has pairs of words as features.
PAIRED = 10
#: Words below which a line has runs of characters; lines between have both, as similar lines may differ in their spaces.
FEW_WORDS = 13
#: Equal coordinates of a candidate pair. The features of similar lines have a Jaccard similarity of 0.5 and more as a rule, with
#: which one pair in a hundred has fewer (at 0.6 one in a thousand).
AGREE = 7
#: (letters of a run, least and most letters of the line); again similar lines of different lengths meet in one kind.
RUNS = ((4, 0, 40), (6, 32, 1 << 30))
#: Lines of so many characters are posted under all forms with one or two characters less, which two of up to two edits share.
DELETED = 14
#: Letters between the anchors at which long lines are cut for a first look, and of an anchor; if that look does not tell, the best of all alignments decides.
PIECE, ANCHOR = 64, 16
#: Lists up to this length give all their pairs; longer ones the pairs with their first member, with CENTRES others, then what is left between components.
SMALL_LIST = 8
#: Characters of all lines of a round's pairs up to which these lines are broadcast: many pairs may be of few lines.
BROADCAST_TEXT = 8_000_000
#: Further members, drawn by hash, that long lists which hold several components are compared with before that, all in one round.
CENTRES = 3
#: Letters that are counted before an alignment, one by one; others are counted as one.
LETTERS = "abcdefghijklmnopqrstuvwxyz "


def normalised(text: Column) -> Column:
    """The text's lines, in lower case, with one space for every run of what is no letter."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\n]++", " "), "\n"), lambda x: F.trim(x))


def _less(text: Column) -> Column:
    """All forms of a short string with one character less."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _signed(lines: DataFrame) -> DataFrame:
    """(line, kind, n, often, signature): the MinHash coordinates of each class, by kind of features, with its length and how often it occurs.

    All occurrences of a class have the same features, which changes no minimum, so minima are taken where lines are read and
    only they are shuffled.
    """
    normal, n = F.col("normal"), F.col("n")
    words = n - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1  # one space between words; splitting is left to the features
    pairs = _let(F.split(normal, " "), lambda w: F.zip_with(w, F.slice(w, 2, F.size(w) - 1), lambda x, y: F.xxhash64(x, y)))  # the last word counts alone, too
    runs = lambda k: F.transform(F.when(n < k, F.array(normal)).otherwise(F.regexp_extract_all(normal, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))), lambda x: F.xxhash64(x))
    kinds = [(words >= PAIRED, pairs)] + [((words < FEW_WORDS) & n.between(least, most), runs(k)) for k, least, most in RUNS]
    made = [lines.where(of).select("line", "n", F.lit(i).alias("kind"), F.posexplode_outer(h).alias("i", "h")) for i, (of, h) in enumerate(kinds)]  # outer: else the array is made twice, to see whether it is empty
    features = reduce(DataFrame.unionByName, made)
    least = features.groupBy("line", "kind").agg(F.first("n").alias("n"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("often"), *[F.min(F.hash("h", F.lit(j))).alias(f"m{j}") for j in range(BANDS * ROWS)])
    return least.select("line", "kind", "n", "often", F.array(*[f"m{j}" for j in range(BANDS * ROWS)]).alias("signature"))


def _posted(lines: DataFrame, signed: DataFrame) -> DataFrame:
    """(key, line, n, often, signature): each class under the keys of its bands; very short ones under those of their shorter forms, too."""
    normal, n = F.col("normal"), F.col("n")
    bands = F.array(*[F.xxhash64("kind", F.lit(b), *[F.get("signature", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(BANDS)])
    banded = signed.select(F.explode(bands).alias("key"), "line", "n", "often", "signature")
    tiny = lines.where(n <= DELETED).groupBy("line", "normal", "n").agg(F.count("*").alias("often"))
    once = _less(normal)
    forms = F.concat(F.array(normal), once, F.when(n > 9, F.flatten(F.transform(once, _less))).otherwise(F.array().cast("array<string>")))
    deleted = tiny.select(F.explode(F.array_distinct(F.transform(forms, lambda x: F.xxhash64(F.lit("less"), x)))).alias("key"), "line", "n", "often", F.lit(None).cast("array<int>").alias("signature"))
    return banded.unionByName(deleted)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once; a plain reference may be copied to wherever it is used."""
    return F.transform(F.array(value), then)[0]


def _common(x: Column, y: Column, most: Column) -> Column:
    """Length of the common beginning of two strings, at most ``most``: ever smaller powers of two are tried and kept."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(24))])
    fits = lambda p, n: (p + n <= most) & (F.substring(x, p + 1, n) == F.substring(y, p + 1, n))
    return F.aggregate(steps, F.lit(0), lambda p, n: F.when(fits(p, n), p + n).otherwise(p))


def _pieces(x: Column, y: Column, most: Column) -> Column:
    """Edits that surely turn ``x`` into ``y``: both are cut where an anchor of ``x`` is found in ``y``, and pieces aligned. Ends beyond ``most``."""
    edits = lambda p, at, q, by: F.levenshtein(F.substring(x, p + 1, at - p), F.substring(y, q + 1, by - q))

    def step(acc: Column, k: Column) -> Column:
        at = k * PIECE
        by = F.call_function("locate", F.substring(x, at + 1, F.lit(ANCHOR)), y, acc["y"] + 1) - 1
        cut = lambda j: F.when(j < 0, acc).otherwise(F.struct(at.alias("x"), j.alias("y"), (acc["edits"] + edits(acc["x"], at, acc["y"], j)).alias("edits")))
        return F.when(acc["edits"] > most, acc).otherwise(_let(by, cut))

    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("edits"))
    end = lambda acc: F.when(acc["edits"] > most, acc["edits"]).otherwise(acc["edits"] + edits(acc["x"], F.length(x), acc["y"], F.length(y)))
    return F.aggregate(F.sequence(F.lit(1), F.floor((F.length(x) - ANCHOR) / PIECE).cast("int")), start, step, end)


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Whether 1 - edits / length of the longer is at least ``percent``.

    Common beginnings and ends take no part in an alignment, so the edits are those of what differs between them.
    """
    size = lambda s, c, h, t: F.substring(s[c], h + 1, F.length(s[c]) - h - t)
    edits = lambda q, most: F.call_function("levenshtein", q["x"], q["y"], most)

    def decide(q: Column, most: Column) -> Column:
        sure = F.greatest(F.length(q["x"]), F.length(q["y"])) <= most
        p, r = F.split(q["x"], " "), F.split(q["y"], " ")
        changed = F.aggregate(F.zip_with(p, r, lambda v, w: F.when(v == w, 0).otherwise(F.greatest(F.length(v), F.length(w)))), F.lit(0), lambda acc, v: acc + v)
        words = (F.size(p) == F.size(r)) & (changed <= most)  # so many edits do at most, word by word
        size = F.least(F.length(q["x"]), F.length(q["y"]))
        anchored = F.when(size > 2 * PIECE, _pieces(q["x"], q["y"], most) <= most).otherwise(False)
        return F.when(sure, True).when(words, True).when(anchored, True).otherwise(edits(q, most) >= 0)

    def middles(s: Column, h: Column) -> Column:
        turned = F.struct(F.reverse(s["x"]).alias("x"), F.reverse(s["y"]).alias("y"), (s["least"] - h).alias("least"))
        tail = _let(turned, lambda r: _common(r["x"], r["y"], r["least"]))
        return _let(tail, lambda t: _let(F.struct(size(s, "x", h, t).alias("x"), size(s, "y", h, t).alias("y")), lambda q: decide(q, s["most"])))

    most = F.floor(F.greatest(F.length(x), F.length(y)) * (100 - percent) / 100).cast("int")
    start = F.struct(x.alias("x"), y.alias("y"), F.least(F.length(x), F.length(y)).alias("least"), most.alias("most"))
    return _let(start, lambda s: _let(_common(s["x"], s["y"], s["least"]), lambda h: middles(s, h)))


def _lengths(x: Column, y: Column, percent: int) -> Column:
    """Whether lines of these lengths can be alike."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _similar(pairs: DataFrame, normal: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose normal forms are alike."""
    few = (normal.agg(F.sum(F.length("normal"))).first()[0] or 0) <= BROADCAST_TEXT
    named = lambda c: (F.broadcast if few else lambda df: df)(normal.select(F.col("line").alias(c), F.col("normal").alias(f"{c}_text")))
    # work is dealt anew before texts meet, and keeps its number of tasks: alignment takes long on few bytes, which AQE would put into few tasks
    n = partitions(pairs.sparkSession)
    if few:
        both = pairs.repartition(n, "a", "b").join(named("a"), "a").join(named("b"), "b")
    else:
        both = pairs.join(named("a"), "a").repartition(n, "b").join(named("b"), "b")
    return both.where(_lengths(F.length("a_text"), F.length("b_text"), percent)).where(_alike(F.col("a_text"), F.col("b_text"), percent)).select("a", "b")


def line_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, place, normal, line, n) of every line with a letter; written to the shared folder."""
    key = content_key(id_col, text_col)
    lines = documents.where(F.col(text_col).isNotNull()).select(key[0].alias("doc"), key[1], F.posexplode(normalised(F.col(text_col))).alias("place", "normal")).where("normal <> ''")
    return materialize(lines.withColumns({"line": F.xxhash64("normal"), "n": F.length("normal")}), "lines")


def _agree(x: Column, y: Column) -> Column:
    """Whether two signatures have enough equal coordinates; those of shorter forms are null and pass."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return F.coalesce(same >= AGREE, F.lit(True))


def _letters(normal: Column) -> Column:
    """How often each of LETTERS stands in a normal form, then how often anything else does."""
    counts = F.array(*[F.length(normal) - F.length(F.replace(normal, F.lit(c), F.lit(""))) for c in LETTERS])
    return _let(counts, lambda c: F.concat(c, F.array(F.length(normal) - F.aggregate(c, F.lit(0), lambda acc, v: acc + v))))


def _reachable(x: Column, y: Column, percent: int) -> Column:
    """False where the letters alone show that lines cannot be alike: an edit takes away one letter at most, and brings one at most."""
    apart = F.aggregate(F.zip_with(x["letters"], y["letters"], lambda p, q: F.abs(p - q)), F.lit(0), lambda acc, v: acc + v)
    return apart + F.abs(x["n"] - y["n"]) <= 2 * F.floor(F.greatest(x["n"], y["n"]) * (100 - percent) / 100)


def _pairs(posted: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), and (key, line, n, signature) of the long lists.

    A long list's centre is its most frequent line: what others are edited copies of stands there more often than any of them, and is
    nearer to all of them than they are to each other.
    """
    shared = materialize(posted.groupBy("key").count().where("count > 1").select("key"), "shared")
    met = materialize(posted.join(small(shared, BROADCAST_ROWS), "key"), "met")
    member = F.struct("line", "n", "signature")
    lists = met.groupBy("key").agg(F.count("*").alias("size"), F.max_by(member, F.struct("often", "line")).alias("centre"))
    listed = materialize(met.join(lists, "key"), "listed")
    few = listed.where(F.col("size") <= SMALL_LIST).groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("c"))
    fits = lambda x, y: _lengths(x["n"], y["n"], percent) & _agree(x["signature"], y["signature"])
    pairs_of = F.flatten(F.transform("c", lambda x, i: F.transform(F.filter(F.slice(F.col("c"), i + 2, F.greatest(F.size("c") - i - 1, F.lit(0))), lambda y: fits(x, y)), lambda y: F.struct(x["line"].alias("a"), y["line"].alias("b")))))
    pairs = few.select(F.explode(pairs_of).alias("p")).select("p.a", "p.b")
    many = listed.where(F.col("size") > SMALL_LIST)
    stars = many.where((F.col("line") != F.col("centre.line")) & fits(F.col("centre"), many)).select(F.col("centre.line").alias("a"), F.col("line").alias("b"))
    return pairs.unionByName(stars).distinct(), many.select("key", "line", "n", "signature")


def line_groups(lines: DataFrame, percent: int = 80) -> DataFrame:
    """(line, group) of the lines that have a similar one; group is the smallest line hash of the component."""
    pairs, many = _pairs(_posted(lines, materialize(_signed(lines), "signed")), percent)
    pairs = materialize(pairs, "pairs")

    def names_of(candidates: DataFrame) -> DataFrame:
        return candidates.select(F.col("a").alias("line")).distinct().union(candidates.select("b").distinct()).distinct()

    # the texts of all lines that any round may compare: lines are read for them once
    compared = small(materialize(names_of(pairs).union(many.select("line").distinct()).distinct(), "names"), BROADCAST_ROWS)
    normal = materialize(lines.join(compared, "line", "left_semi").groupBy("line").agg(F.first("normal").alias("normal")), "normal")

    def links_of(candidates: DataFrame) -> DataFrame:
        names = small(materialize(names_of(candidates), "names"), BROADCAST_ROWS)
        return materialize(_similar(candidates, normal.join(names, "line", "left_semi"), percent), "links")

    found = materialize(components(links_of(pairs)), "components")

    members = small(materialize(many.select("line").distinct(), "members"), BROADCAST_ROWS)
    letters = materialize(normal.join(members, "line", "left_semi").select("line", _letters(F.col("normal")).alias("letters")), "letters")
    fits = lambda x, y: _lengths(x["n"], y["n"], percent) & _agree(x["signature"], y["signature"]) & _reachable(x, y, percent)
    for drawn in (True, False):  # first the drawn members of all lists at once, then what they have left between components
        where = many.join(found.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
        several = where.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        rest = materialize(where.join(several, "key", "left_semi").join(letters, "line"), "rest")
        if rest.isEmpty():
            break
        if drawn:
            centres = rest.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("line", F.lit(r)).alias("draw"), "line", "n", "signature", "letters", "component")) for r in range(CENTRES)]).alias("c"))
            others = F.filter("c", lambda c: (c["component"] != F.col("component")) & fits(c, F.struct("n", "signature", "letters")))
            led = rest.join(centres, "key").select("line", F.explode(F.transform(others, lambda c: c["line"])).alias("other"))
            met = led.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b"))
        else:
            x, y = (rest.select("key", "component", "line", F.struct("n", "signature", "letters").alias("own")).alias(c) for c in "xy")
            led = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & fits(F.col("x.own"), F.col("y.own")))
            met = led.select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b"))
        more = materialize(met.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        pairs = pairs.unionByName(more)
        found = materialize(components(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links_of(more))), "components")
    return found.select(F.col("node").alias("line"), F.col("component").alias("group"))


def drop_list(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, places): the lines to drop of each document that has any."""
    lines = line_table(documents, id_col, text_col)
    groups = small(line_groups(lines, percent), BROADCAST_ROWS)
    placed = lines.select("doc", "text_hash", "place", "line").join(groups, "line", "left").withColumn("group", F.coalesce("group", "line")).drop("line")
    first = placed.groupBy("group").agg(F.count("*").alias("size"), F.min(F.struct("doc", "text_hash", "place")).alias("first")).where("size > 1").select("group", "first")
    first = small(materialize(first, "first"), BROADCAST_ROWS)
    again = placed.join(first, "group").where(~F.struct("doc", "text_hash", "place").eqNullSafe(F.col("first")))
    return again.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list("place")).alias("places"))


def dedup_lines(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the text's repeated lines taken out, and n_lines and n_dropped (long) added.

    A line is what stands between two newlines. Lines without a letter are never dropped. Of each group of similar lines
    (in one document or many) the first one by id, text hash and place stays; a null id comes first. Documents with equal
    id and text are one document. A null text stays null with no lines; an empty one has one line. All other columns are
    kept; columns named n_lines or n_dropped are replaced. No documents give no rows.
    """
    dropped = small(materialize(drop_list(documents, percent, id_col, text_col), "dropped"), BROADCAST_ROWS)
    own = unused("hash", documents)
    d, r = documents.withColumn(own, content_key(id_col, text_col)[1]).alias("d"), dropped.alias("r")
    joined = d.join(r, F.col(f"d.{id_col}").eqNullSafe(F.col("r.doc")) & (F.col(f"d.{own}") == F.col("r.text_hash")), "left")
    kept = F.when(F.col("r.places").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(F.filter(F.split(F.col(f"d.{text_col}"), "\n"), lambda _, i: ~F.array_contains(F.col("r.places"), i)), "\n"))
    n = F.when(F.col(f"d.{text_col}").isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(f"d.{text_col}"), "\n")))
    columns = [kept.alias(c) if c == text_col else F.col(f"d.{c}") for c in documents.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, n.cast("long").alias("n_lines"), F.when(F.col("r.places").isNull(), F.lit(0)).otherwise(F.size("r.places")).cast("long").alias("n_dropped"))
