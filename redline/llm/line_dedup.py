"""Line dedup by a log-template tree of fixed depth.

Every line with at least ``MIN_TOKENS`` words is tokenised and tokens that hold a digit become the
wildcard.  The tree has two levels below its root: the token count, then the leading ``DEPTH``
tokens; a leaf holds the lines that agree on both.  In leaves that several documents share, the
positions whose most frequent token covers at least ``CONSTANT`` of the leaf's distinct lines stay,
the others are variable fields.  Lines that agree with this template in at least ``SIMILAR`` of
their positions after the leading ones, wildcards not counted, belong to it if it has at least
``MIN_CONSTANT`` constant words there; the others are templates of their own.  A line of which fewer
than ``MIN_CONSTANT`` words, or less than ``CONSTANT``, hold no digit (table rows) keeps its digits:
it recurs only as it is.

A template recurs when documents that are otherwise different share it.  Texts are put into
families of near copies: texts that hold a long shingle in common are compared with the first of
them, by the smallest three-word shingle hashes of the whole text (short texts: by their words); at
least ``ALIKE`` of these agree in near copies, and families are what such links connect.  Texts that
consist of the line alone are one family.  ``MIN_CONTEXTS`` families make a template recur, two
(``LONG_CONTEXTS``) one of at least ``LONG`` words, however many texts each of them holds: more copies never bring a line back.  So passages and boilerplate go,
and families of exact or near copies keep their lines for the document-level dedup.  All lines of
recurring templates are dropped; blank and short lines stay.

Only DataFrame functions are used.  Hot templates are pre-aggregated before each shuffle; joins on
a template carry hashes only.  Line hashes are 64 bits, texts are keyed by MD5.

Defined cases: a null text stays null; an empty text stays empty; a text whose lines all recur
becomes empty; repeated rows and exact copies count as one text and get the same result; an empty
table gives no rows; all other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import let, stored
from redline.llm.components import components

MIN_TOKENS = 3
DEPTH = 3
CONSTANT = 0.5
SIMILAR = 0.6
MIN_CONSTANT = 3
MIN_CONTEXTS = 4
LONG = 50
LONG_CONTEXTS = 2
WILD = "<*>"
#: Single characters make one table look-up a character; with a range in the class it takes twice as long.
DIGIT_OR_WHITE = "[\t\x0b\f\r0123456789]"
#: Only looked for where a word begins, without steps back: linear in the line, however long its words.
WITH_DIGIT = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
#: Near copies agree in so much of their sketches; a sketch holds so many shingles.
ALIKE = 0.65
SKETCH = 64
#: Texts of up to so many words, or with fewer sampled shingles, are compared by their words.
SHORT = 64
MIN_SAMPLE = 16
#: Shingles of a text by which copies meet.
MEET = 16
#: Up to so many lines of shared leaves their positions are broadcast; beyond, texts are shuffled.
MAX_BROADCAST_LINES = 200_000


def masked_words(line: Column) -> Column:
    """A line whose other white space is blanks, cut at each blank; words with a digit become the wildcard."""
    return F.split(F.when(line.rlike("[0-9]"), F.regexp_replace(line, WITH_DIGIT, WILD)).otherwise(line), " ")


def masked_tokens(line: Column) -> Column:
    """The words of ``masked_words``, without the empty ones between blanks."""
    return F.array_remove(masked_words(line), "")


def blanked(text: Column) -> Column:
    """The text with blanks for all ASCII white space but line feeds."""
    return F.when(text.rlike("[\t\x0b\f\r]"), F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)


def _smallest(shingles: str, most) -> Column:
    """The smallest distinct of ascending hashes: nearly always among twice as many of the first."""
    first = F.array_distinct(F.slice(shingles, 1, 2 * most))
    return F.slice(F.when((F.size(first) >= most) | (F.size(shingles) <= 2 * most), first).otherwise(F.array_distinct(shingles)), 1, most)


def _shingles(at, n: int) -> Column:
    """The hashes of the n words from each of these positions of h on."""
    return let(F.col("h"), lambda h: F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j if j else i) for j in range(n)])))


def _positions(n: int) -> Column:
    """All positions from which n words of h are left."""
    return F.slice(F.sequence(F.lit(0), F.size("h")), 1, F.greatest(F.size("h") - (n - 1), F.lit(0)))


def text_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, any, ls, sk): per text its MD5, has it templated lines, these, and its sketch.

    A sketch holds the number n of the text's words, norm (the hash of their hashes), and what tells near
    copies: the smallest three-word shingles s (long texts), the distinct words w (short texts, and the
    next longer ones that these may be copies of) and the shingles b by which copies meet.  Shingles begin
    with one word in four, chosen by its hash: the same ones in any copy.

    Lambda functions run interpreted: they only hash words, lines and shingles and pick where shingles
    begin.  Arrays are joined, sorted and cut in selects of their own, where compiled code does it, once."""
    text, h, empty, wild = F.col("text"), F.col("h"), F.xxhash64(F.lit("")), F.xxhash64(F.lit(WILD))
    docs = df.select(F.col(text_col).alias("text")).filter(text.isNotNull())
    # Every word is hashed once; texts without digits and odd white space are looked at once for both.
    def cut(text, tokens):
        return F.transform(F.split(text, "\n"), lambda x: F.struct(F.transform(tokens(x), lambda w: F.xxhash64(w)).alias("h"), x.alias("x")))
    looked = docs.select("text", text.rlike(DIGIT_OR_WHITE).alias("odd"))
    tokens = looked.select(F.unhex(F.md5("text")).alias("key"), (
        F.when(F.col("odd"), cut(blanked(text), masked_words)).otherwise(cut(text, lambda x: F.split(x, " ")))).alias("t"))
    flat = tokens.select("key", "t", F.flatten("t.h").alias("h"))
    flat = flat.select("key", "t", F.array_remove("h", empty).alias("h"), F.array_contains("h", empty).alias("empty"),
                       F.array_contains("h", wild).alias("wild"))

    def line(x, i):
        def of(h, fixed):
            sparse = (fixed < F.size(h)) & ((fixed < MIN_CONSTANT) | (fixed < CONSTANT * F.size(h)))
            plain = F.xxhash64(F.array_remove(F.split(x["x"], " "), ""))
            leaf = F.xxhash64(F.size(h), *[F.get(h, F.lit(j)) for j in range(DEPTH)])
            return F.struct(i.alias("no"), F.size(h).alias("size"), F.when(
                F.col("wild") & sparse, let(plain, lambda p: F.struct(p.alias("leaf"), p.alias("tmpl"))))
                .otherwise(F.struct(leaf.alias("leaf"), F.xxhash64(h).alias("tmpl"))).alias("at"))
        words = F.when(F.col("empty"), F.array_remove(x["h"], empty)).otherwise(x["h"])
        return let(words, lambda h: let(F.when(F.col("wild"), F.size(F.array_remove(h, wild))), lambda fixed: of(h, fixed)))
    at = flat.select("key", "h", F.filter(F.transform("t", line), lambda x: x["size"] >= MIN_TOKENS).alias("ls"), F.array_remove(
        F.transform("h", lambda w, i: F.when((w.bitwiseAND(3) == 0) & (i <= F.size("h") - 3), i).otherwise(-1)), -1).alias("at"))
    three = at.select("*", F.sort_array(_shingles("at", 3)).alias("three"))
    s = three.select("key", "h", "ls", "at", _smallest("three", SKETCH).alias("s"))
    short = s.select("*", ((F.size("h") <= SHORT) | (F.size("s") < MIN_SAMPLE)).alias("short"))
    of = short.select("*", F.when(F.col("short"), _positions(6)).otherwise(F.filter("at", lambda i: i <= F.size("h") - 6)).alias("at6"),
                      F.when(F.col("short"), _positions(3)).otherwise(F.array().cast("array<int>")).alias("at3"))
    meet = of.select("key", "h", "ls", "s", "short", F.sort_array(F.concat(_shingles("at6", 6), _shingles("at3", 3))).alias("meet"))
    return meet.select("key", (F.size("ls") > 0).alias("any"), "ls", F.struct(
        F.size("h").alias("n"), F.xxhash64("h").alias("norm"), "short", F.when(~F.col("short"), F.col("s")).alias("s"),
        F.when(F.col("short") | (F.size("h") <= 2 * SHORT), F.slice(F.sort_array(F.array_distinct("h")), 1, 2 * SHORT)).alias("w"),
        _smallest("meet", F.when(F.col("short"), 2 * MEET).otherwise(MEET)).alias("b")).alias("sk"))


def _alike(a: str, b: str) -> Column:
    """Do two sketches agree in most of what they hold: words if one text is short, else shingles."""
    aw, bw = F.col(f"{a}.w"), F.col(f"{b}.w")
    least = F.slice(F.sort_array(F.array_union(f"{a}.s", f"{b}.s")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(f"{a}.s", f"{b}.s"), least))
    words = F.size(F.array_intersect(aw, bw)) >= ALIKE * F.size(F.array_union(aw, bw))
    return F.coalesce(F.when(F.col(f"{a}.short") | F.col(f"{b}.short"), words).otherwise(both >= ALIKE * F.size(least)), F.lit(False))


def families(texts: DataFrame) -> DataFrame:
    """(node, root): texts (by their norm) that are near copies of others, with their family.

    The texts that hold a shingle are compared with the smallest of them, one row per text and
    shingle; what agrees is linked, and families are the connected components."""
    met = texts.select("sk.norm", F.explode("sk.b").alias("e"))
    first = (met.groupBy("e").agg(F.min("norm").alias("lead"), F.max("norm").alias("last"))
             .filter("lead < last").select("e", "lead"))
    pairs = stored(met.join(first, "e").filter("norm <> lead").select("norm", "lead").distinct(), "line-pairs")
    nodes = pairs.select("norm").unionByName(pairs.select(F.col("lead").alias("norm"))).distinct()
    sketches = stored(texts.select("sk.norm", "sk").join(nodes, "norm", "left_semi").dropDuplicates(["norm"]), "line-sketches")
    edges = (pairs.join(sketches.select("norm", F.col("sk").alias("a")), "norm")
             .join(sketches.select(F.col("norm").alias("lead"), F.col("sk").alias("b")), "lead")
             .filter(_alike("a", "b")).select(F.col("norm").alias("u"), F.col("lead").alias("v")))
    return components(edges)


def shared_lines(texts: DataFrame) -> DataFrame:
    """(key, norm, alone, no, leaf, tmpl, size): one narrow row per templated line whose leaf holds
    another template or another text; the other lines cannot recur.  alone tells that the text has
    nothing else to tell."""
    rest = F.col("sk.n") - F.get("ls", F.lit(0))["size"]
    alone = (F.size("ls") == 1) & (rest < MIN_TOKENS)
    lines = (texts.select("key", "sk.norm", alone.alias("alone"), F.explode("ls").alias("l"))
             .select("key", "norm", "alone", "l.no", "l.at.leaf", "l.at.tmpl", "l.size"))
    leaves = (lines.groupBy("leaf").agg(F.min("norm").alias("n0"), F.max("norm").alias("n1"), F.min("tmpl").alias("t0"), F.max("tmpl").alias("t1"))
              .filter("n0 < n1 OR t0 < t1").select("leaf"))
    # Hashed: the few shared leaves are the smaller side by far, and the lines need no sort.
    return lines.join(leaves.hint("shuffle_hash"), "leaf", "left_semi")


def line_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, ctx, alone, no, leaf, tmpl, size): the rows of ``shared_lines``, key is the text's MD5,
    ctx its family."""
    # Filtered once stored: a filter on a computed column would compute it twice.
    texts = stored(text_table(df, text_col), "line-texts").filter("any").drop("any")
    return (shared_lines(texts).join(families(texts), F.col("norm") == F.col("node"), "left")
            .select("key", F.coalesce("root", "norm").alias("ctx"), "alone", "no", "leaf", "tmpl", "size"))


def _enough() -> Column:
    """The families that make a line of ``size`` words recur."""
    return F.when(F.col("size") >= LONG, LONG_CONTEXTS).otherwise(MIN_CONTEXTS)


def _dense(lines: DataFrame) -> DataFrame:
    """One line per distinct template of the leaves that several contexts share and that hold
    more than one template: (leaf, tmpl, key, no)."""
    each = (lines.groupBy("leaf", "tmpl", "ctx").agg(F.min(F.struct("key", "no")).alias("at"), F.min("size").alias("size"))
            .groupBy("leaf", "tmpl").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("at"), F.min("size").alias("size")))
    leaves = (each.groupBy("leaf").agg(F.count(F.lit(1)).alias("t"), F.sum("c").alias("c"), F.min("size").alias("size"))
              .filter((F.col("t") > 1) & (F.col("c") >= _enough())).select("leaf"))
    return each.join(leaves, "leaf", "left_semi").select("leaf", "tmpl", "at.key", "at.no")


def leaf_members(df: DataFrame, lines: DataFrame, text_col: str = "text") -> DataFrame:
    """(tmpl, leaf): the templates that their leaf's generalised template covers."""
    reps = stored(_dense(lines), "line-reps")
    texts = (df.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
             .select(F.unhex(F.md5("text")).alias("key"), "text"))
    wanted = reps.groupBy("key").agg(F.collect_list(F.struct("leaf", "tmpl", "no")).alias("w"))
    if reps.count() <= MAX_BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    # Only the texts that hold such a line are cut.
    tokens = (texts.join(wanted, "key").select(F.split(blanked(F.col("text")), "\n").alias("ls"), "w")
              .select("ls", F.explode("w").alias("w"))
              .select("w.leaf", "w.tmpl", masked_tokens(F.get("ls", F.col("w.no"))).alias("t"))
              .dropDuplicates(["leaf", "tmpl"]))
    tokens = stored(tokens, "line-tokens")
    at = (tokens.select("leaf", F.posexplode("t").alias("pos", "token"))
          .groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("n"))
          .groupBy("leaf", "pos").agg(F.sum("n").alias("total"), F.max(F.struct("n", "token")).alias("top")))
    constant = F.when((F.col("top.n") >= CONSTANT * F.col("total")) & (F.col("top.n") > 1), F.col("top.token")).otherwise(WILD)
    template = (at.select("leaf", F.struct("pos", constant.alias("token")).alias("p"))
                .groupBy("leaf").agg(F.sort_array(F.collect_list("p"))["token"].alias("template")))
    # All lines of a leaf agree in the leading tokens: only those after them tell.
    after = F.slice("template", DEPTH + 1, F.greatest(F.size("template") - DEPTH, F.lit(0)))
    template = template.withColumn("template", after).filter(F.size(F.array_remove("template", WILD)) >= MIN_CONSTANT)
    rest = F.slice("t", DEPTH + 1, F.size("template"))
    agree = F.aggregate(F.zip_with(rest, "template", lambda a, b: ((a == b) & (a != WILD)).cast("int")), F.lit(0), lambda s, x: s + x)
    return (tokens.join(template, "leaf").filter(agree >= SIMILAR * F.size("template")).select("tmpl", "leaf"))


def recurring(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(tmpl): the line templates whose generalised template recurs across documents."""
    seen = lines.groupBy("tmpl", "ctx").agg(F.min("alone").alias("alone"), F.min("size").alias("size"))
    group = F.when(F.col("leaf").isNull(), F.struct(F.lit(0).alias("k"), F.col("tmpl").alias("h"))).otherwise(
        F.struct(F.lit(1).alias("k"), F.col("leaf").alias("h")))
    grouped = seen.join(members, "tmpl", "left").select(group.alias("g"), "ctx", "alone", "size")
    # Texts that consist of the line are copies of each other: one family, whatever they differ in.
    support = (grouped.groupBy("g", "ctx").agg(F.min("alone").alias("alone"), F.min("size").alias("size"))
               .groupBy("g").agg((F.count_if(~F.col("alone")) + F.max(F.col("alone").cast("long"))).alias("c"),
                                 F.min("size").alias("size"))
               .filter(F.col("c") >= _enough()))
    alone = support.filter(F.col("g.k") == 0).select(F.col("g.h").alias("tmpl"))
    general = support.filter(F.col("g.k") == 1).select(F.col("g.h").alias("leaf"))
    covered = members.join(general, "leaf", "left_semi").select("tmpl")
    return alone.unionByName(covered).distinct()


def mark_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(row: the input row as a struct, lines: its lines, drop: positions of the lines that go)."""
    lines = stored(line_table(df, text_col), "lines")
    members = stored(leaf_members(df, lines, text_col), "line-members")
    gone = stored(recurring(lines, members), "line-recurring")
    drops = (lines.join(gone, "tmpl", "left_semi").groupBy("key").agg(F.collect_set("no").alias("drop")))
    drops = stored(drops, "line-drops").withColumnRenamed("key", "drop_key")
    rows = df.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    return (rows.withColumn("key", F.unhex(F.md5(text)))
            # Hashed: the narrow side is built, the rows with their texts need no sort.
            .join(drops.hint("shuffle_hash"), F.col("key") == F.col("drop_key"), "left")
            .select("row", F.split(text, "\n").alias("lines"),
                    F.coalesce("drop", F.array().cast("array<int>")).alias("drop")))


def kept_text() -> Column:
    """The text of a ``mark_lines`` row without the dropped lines."""
    left = F.filter("lines", lambda x, i: ~F.array_contains(F.col("drop"), i))
    return F.when(F.size("drop") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(left, "\n"))


def drop_recurring_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with the recurring lines taken out of the text column."""
    m = mark_lines(df, text_col).withColumn("kept", kept_text())
    return m.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
