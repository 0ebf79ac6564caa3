"""Line dedup by content-defined chunks of lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

#: Bits of a filter that tells which hashes may recur: 16 MB at any input size. Where it fills up, more rows move for nothing.
BITS = 1 << 27
#: A line may end a chunk for one in MODULUS of its rolling hashes, unless the line before it may as well, so chunks have two lines
#: or more; a line of more than LONG words is a chunk of its own.
MODULUS, LONG = 3, 50


def _key() -> F.Column:
    """A row's key: doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), "text")


def _chunked(docs: DataFrame, modulus: int, long: int) -> DataFrame:
    """docs with lines, key (of doc_id and text) and chunks: (start, end) line numbers, end inclusive."""
    lined = docs.withColumn("text", text_of()).withColumn("lines", F.split("text", "\n", -1))
    lined = lined.withColumn("key", _key())
    # a line's hash: 32 bits of its MD5; the rolling hash joins it to the line before
    lined = lined.withColumn("h", F.expr("transform(lines, x -> cast(conv(substring(md5(x), 1, 8), 16, 10) as bigint))"))
    lined = lined.withColumn("long", F.expr(rf"transform(lines, x -> length(x) > {long} and regexp_count(x, r'{WORD}') > {long})"))
    lined = lined.withColumn("may", F.expr(f"transform(h, (x, i) -> (if(i > 0, h[i - 1], 0L) * 31 + x) % {modulus} = 0)"))
    ends = F.expr("""filter(sequence(0, size(lines) - 1), i -> i = size(lines) - 1 or long[i] or long[i + 1]
                      or (may[i] and not (i > 0 and may[i - 1] and not long[i - 1])))""")
    lined = lined.withColumn("ends", ends)
    return lined.withColumn("chunks", F.expr("transform(ends, (e, i) -> struct(if(i > 0, ends[i - 1] + 1, 0) as start, e as end))"))


def _pieces(chunked: DataFrame) -> DataFrame:
    """(doc_id, key, start, h1, chunk, before, after) of the chunks that may be removed: of several lines, or one long line;
    with the lines of the chunks on both sides."""
    text = "slice(lines, chunks[{0}].start + 1, chunks[{0}].end - chunks[{0}].start + 1)"
    none = "filter(lines, x -> false)"
    piece = f"""struct(c.start as start, array_join({text.format('i')}, '\n') as chunk,
                       if(i > 0, {text.format('i - 1')}, {none}) as before, if(i + 1 < size(chunks), {text.format('i + 1')}, {none}) as after)"""
    # texts are cut out before they are exploded, so that no row carries the whole document
    some = F.expr(f"filter(transform(chunks, (c, i) -> if(c.end > c.start or long[c.start], {piece}, null)), p -> p is not null)")
    each = chunked.select("doc_id", "key", F.explode(some).alias("p")).select("doc_id", "key", "p.*")
    return each.withColumn("h1", F.xxhash64("chunk"))


def _bit(hash_: str) -> tuple[F.Column, F.Column]:
    at = F.pmod(F.col(hash_), F.lit(BITS)) + 1
    return F.bitmap_bucket_number(at), F.bitmap_bit_position(at)


def _filter(hashes: DataFrame, hash_: str) -> DataFrame:
    """(bucket, bits): a bit for each hash; BITS / 32768 rows of 4 KB at most."""
    bucket, bit = _bit(hash_)
    return stored(hashes.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")), "line-filter")


def _marked(df: DataFrame, hash_: str, bits: DataFrame) -> DataFrame:
    """df with may: whether the filter has the row's hash."""
    bucket, bit = _bit(hash_)
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = df.withColumn("bucket", bucket).withColumn("_bit", bit).join(F.broadcast(bits), "bucket", "left")
    may = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1")
    return out.withColumn("_byte", F.coalesce(byte, F.lit(0))).withColumn("may", may).drop("bucket", "bits", "_bit", "_byte")


def dedup_lines(docs: DataFrame, modulus: int = MODULUS, long: int = LONG) -> DataFrame:
    """docs with n_lines, n_removed (lines) and text without repeated chunks; n_lines and n_removed replace columns so named.

    Lines end at \\n. Boundaries depend on a few lines before (and on long lines), so equal passages are cut alike wherever
    they stand; a chunk of several lines, or one line of more than `long` words, that stands elsewhere too is removed but
    for its first place, by doc_id (null last), then text's hash, then line. With it go the lines beside it, up to a
    chunk's length on each side, that are equal beside the first place too: a repeated passage goes with its ends, which
    stand in chunks with other lines. The first place of a repeated chunk stays whole. Hashes only choose candidates:
    chunks and lines are equal if their bytes are. Other columns stay, whatever their names.

    A hot chunk's places meet in partial aggregates; those are stored, so that adaptive execution can split its rows in the
    join (it does so above no aggregate); texts move once, to be joined with what goes. Nulls: a null
    text is empty (one empty line, nothing removed); a null doc_id keeps its row. Rows of equal doc_id and text count as
    one document and get the same result. No documents give no rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).withColumn("doc_id", F.col("_row.doc_id")).withColumn("text", text_of("_row.text"))
    pieces = _pieces(_chunked(plain.select("doc_id", "text"), modulus, long))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    spots = stored(pieces.groupBy("h1").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("h1"), "line-hashes")
    # of the chunks' texts, those that recur move
    again = _marked(pieces, "h1", _filter(spots, "h1")).filter("may").drop("may").join(spots, "h1", "left_semi")
    again = stored(again, "line-chunks")
    first = again.groupBy("h1", "chunk").agg(F.min(F.struct(place.alias("place"), F.col("before").alias("before"), F.col("after").alias("after"))).alias("first"), F.max(place).alias("last"))
    first = stored(first.filter("first.place <> last").select("h1", "chunk", "first"), "line-first")
    gone = again.join(first, ["h1", "chunk"]).filter(place != F.col("first.place"))
    alike = "aggregate(sequence(1, least(size({0}), size(first.{0}))), 0, (n, k) -> if(n = k - 1 and {1}, k, n))"
    beside = lambda name, equal: F.when((F.size(name) > 0) & (F.size(f"first.{name}") > 0), F.expr(alike.format(name, equal))).otherwise(0)
    gone = gone.select("key", "start", beside("before", "before[size(before) - k] = first.before[size(first.before) - k]").alias("ahead"), beside("after", "after[k - 1] = first.after[k - 1]").alias("behind"), F.lit(False).alias("stays"))
    stays = first.select("first.place.key", "first.place.start", F.lit(0).alias("ahead"), F.lit(0).alias("behind"), F.lit(True).alias("stays"))
    said = F.struct("start", "ahead", "behind")
    gone = gone.unionByName(stays).groupBy("key").agg(F.collect_set(F.when(~F.col("stays"), said)).alias("gone"), F.collect_set(F.when(F.col("stays"), F.col("start"))).alias("stays"))
    gone = stored(gone.filter("size(gone) > 0"), "line-gone")
    # of the documents, those that lose lines move
    keyed = _marked(plain.withColumn("key", _key()), "key", _filter(gone, "key"))
    whole = keyed.filter("not may").withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")).withColumn("n_removed", F.lit(0).cast("long"))
    cut = _chunked(keyed.filter("may").join(gone, "key", "left"), modulus, long)
    # line numbers: of chunks that go, with the lines beside them, but for those of chunks that stay
    whole_chunks = "flatten(transform(filter(chunks, c -> array_contains(stays, c.start)), c -> sequence(c.start, c.end)))"
    beside = "flatten(transform(gone, g -> sequence(g.start - g.ahead, element_at(filter(ends, e -> e >= g.start), 1) + g.behind)))"
    cut = cut.withColumn("dropped", F.expr(f"if(gone is null, array(), array_except({beside}, {whole_chunks}))")).withColumn("n_lines", F.size("lines").cast("long"))
    cut = cut.withColumn("n_removed", F.size("dropped").cast("long"))
    rest = F.expr("if(size(dropped) = 0, text, array_join(transform(array_except(sequence(0, size(lines) - 1), dropped), i -> lines[i]), '\n'))")
    names = [*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns], F.col("n_lines"), F.col("n_removed")]
    return whole.select(names).unionByName(cut.withColumn("text", rest).select(names))


def query(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: The same in SQL; chunks are grouped by their text.
SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h,
             list_transform(lines, lambda x: len(regexp_extract_all(x, '{WORD}')) > {LONG}) AS long FROM d),
m AS (SELECT *, list_transform(range(1, len(lines) + 1), lambda i: (CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END * 31 + h[i]) % {MODULUS} = 0) AS may FROM l),
e AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR long[i] OR coalesce(long[i + 1], false)
             OR (may[i] AND NOT (i > 1 AND coalesce(may[i - 1], false) AND NOT coalesce(long[i - 1], false)))) AS ends FROM m),
c AS (SELECT doc_id, lines, long, unnest(list_transform(range(1, len(ends) + 1), lambda k: struct_pack(a := CASE WHEN k > 1 THEN ends[k - 1] + 1 ELSE 1 END, b := ends[k]))) AS c FROM e),
t AS (SELECT doc_id, c.a AS a, c.b AS b, lines[c.a : c.b] AS own, array_to_string(lines[c.a : c.b], chr(10)) AS chunk, c.b > c.a OR long[c.a] AS may FROM c),
n AS (SELECT *, coalesce(lag(own) OVER w, []) AS before, coalesce(lead(own) OVER w, []) AS after FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
r AS (SELECT *, row_number() OVER w AS o, count(*) OVER (PARTITION BY chunk) AS places, first_value(before) OVER w AS fb, first_value(after) OVER w AS fa FROM n WHERE may WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, a)),
g AS (SELECT doc_id, a, b, len(list_filter(range(1, least(len(before), len(fb)) + 1), lambda k: before[len(before) - k + 1 :] = fb[len(fb) - k + 1 :])) AS ahead,
             len(list_filter(range(1, least(len(after), len(fa)) + 1), lambda k: after[1 : k] = fa[1 : k])) AS behind FROM r WHERE o > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(a - ahead, b + behind + 1)) AS i FROM g EXCEPT SELECT doc_id, unnest(range(a, b + 1)) FROM r WHERE o = 1 AND places > 1),
y AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
SELECT y.doc_id, count(*) AS n_lines, count(x.i) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY y.i) FILTER (WHERE x.i IS NULL), '')) AS text_sha256
FROM y LEFT JOIN x ON x.doc_id = y.doc_id AND x.i = y.i GROUP BY y.doc_id
"""
