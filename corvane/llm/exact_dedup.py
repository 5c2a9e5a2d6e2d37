"""Exact deduplication by deterministic block naming (operator 2).

A text is cut into blocks of fixed size. The distinct blocks are sorted and numbered, so equal blocks, and only they,
have equal names. Then adjacent names are paired and the distinct pairs sorted and numbered again, until each
document has one name: two documents have the same name exactly if their texts are equal.

A block is addressed by its 64-bit hash while it travels, but no hash is trusted: the least and the greatest block of
each hash are compared, and should they differ, that hash's blocks are joined by their content. The texts are
shuffled once (combined before the shuffle, so copies travel once per task); all later rows are three numbers.

Hot texts: names are made from combined rows; joining names back is a plain equi-join, whose hot side adaptive
execution splits; the group's size and survivor are combined before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Tables, slots


def block_of(text: str, pos: str, size: int) -> str:
    """SQL for the bytes of block `pos`, of a binary column."""
    return f"substring({text}, cast({pos} * {size} + 1 as int), {size})"


def number(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys -> name: their order within hash partitions, unique over all of them. Fixed once written."""
    return rows.repartition(slots(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, tables: Tables, block_size: int, text_col: str = "text", id_col: str = "doc_id", hash_sql: str = "xxhash64({})", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, sha, level, name) for each row of docs: (level, name) is its text's identity, row its row_col or,
    without one, a new number."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    n_blocks = f"greatest(1, cast(ceil(octet_length(t) / {block_size}) as int))"
    blocks = f"transform(sequence(0, {n_blocks} - 1), i -> {block_of('b', 'i', block_size)})"
    cutted = base.withColumn("b", F.col("t").cast("binary"))
    rows = tables.write(
        cutted.select(
            F.col("row") if row_col else F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("b", 256).alias("sha"),
            F.expr(f"transform({blocks}, x -> {hash_sql.format('x')})").alias("hashes"),
        ),
        "rows",
    )
    content = cutted.select(F.explode(F.expr(blocks)).alias("block")).select(F.expr(hash_sql.format("block")).alias("h"), "block")
    least = content.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    checked = tables.write(least.select("h", (F.col("lo") != F.col("hi")).alias("clash"), F.col("lo").alias("block")).sortWithinPartitions("h", "block").select("h", "clash", F.monotonically_increasing_id().alias("name")), "names0")
    place = rows.select("row", F.posexplode("hashes").alias("pos", "h"))
    level = place.join(checked.filter(~F.col("clash")).select("h", "name"), "h").select("row", "pos", "name")
    if not checked.filter("clash").isEmpty():
        level = level.unionByName(by_content(cutted, rows, checked, blocks, hash_sql, tables))
    level = tables.write(level, "level0")
    done, depth = [], 0
    while True:
        # A row whose length is done has one name; the others' names are paired.
        size = rows.select("row", F.size("hashes").alias("n"))
        one = f"ceil(n / cast(pow(2, {depth}) as long))"
        prev = f"ceil(n / cast(pow(2, {depth - 1}) as long))"
        ended = size.filter(f"{one} = 1" + (f" and {prev} > 1" if depth else "")).select("row")
        done.append(level.join(ended, "row").select("row", F.lit(depth).alias("level"), "name"))
        if size.filter(f"{one} > 1").isEmpty():
            break
        open_rows = level.join(size.filter(f"{one} > 1").select("row"), "row")
        even = F.col("pos") % 2 == 0
        pairs = open_rows.groupBy("row", F.expr("cast(floor(pos / 2) as int)").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = tables.write(pairs, f"pairs{depth + 1}")
        names = tables.write(number(pairs.select("a", "b").distinct(), "a", "b"), f"names{depth + 1}")
        level = tables.write(pairs.join(names, ["a", "b"]).select("row", "pos", "name"), f"level{depth + 1}")
        tables.release(f"pairs{depth + 1}", f"names{depth + 1}")
        depth += 1
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    return rows.drop("hashes").join(named, "row")


def by_content(cutted: DataFrame, rows: DataFrame, checked: DataFrame, blocks: str, hash_sql: str, tables: Tables) -> DataFrame:
    """Names of blocks whose hash another block has too: numbered and joined by content. The texts are read again
    with the same row numbers, which the identity of (doc_id, sha) ties to them."""
    clash = checked.filter("clash").select("h", "name")
    texts = cutted.select("doc_id", F.sha2("b", 256).alias("sha"), F.expr(f"transform({blocks}, x -> struct({hash_sql.format('x')} as h, x as block))").alias("z")).distinct()
    placed = texts.select("doc_id", "sha", F.posexplode("z").alias("pos", "x")).select("doc_id", "sha", "pos", F.col("x.h").alias("h"), F.col("x.block").alias("block")).join(clash.select("h"), "h", "left_semi")
    order = placed.select("h", "block").distinct()
    # Negative names: no checked block has one.
    names = tables.write(number(order, "h", "block").withColumn("name", -2 - F.col("name")), "clashes")
    ids = rows.select("row", "doc_id", "sha")
    got = placed.join(names, ["h", "block"])
    return got.join(ids, (got.doc_id.eqNullSafe(ids.doc_id)) & (got.sha == ids.sha)).select("row", "pos", "name")


def exact_survivors(docs: DataFrame, row_col: str, block_size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row): the number of the one row that stays of equal texts, by row_col, which numbers the rows of docs.

    It is the row with the largest id, of several the least row number; a row without an id stays only where no row
    has one."""
    tables = Tables(docs.sparkSession, "exact")
    named = block_names(docs, tables, block_size, text_col, id_col, row_col=row_col)
    best = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("best"))
    out = tables.write(best.select((-F.col("best.back")).alias("row")), "survivors")
    tables.release(*[k for k in list(tables.paths) if k != "survivors"])
    return out


def exact_dedup(docs: DataFrame, block_size: int = 4096, id_col: str = "doc_id", text_col: str = "text", hash_sql: str = "xxhash64({})") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs; the largest id of equal texts stays.

    Defined results: null text counts as empty, and empty texts form a group; a null id stays only in a group without
    ids (keep_id null); rows that repeat the kept id with the same text stay once each row says kept (equal rows are
    not told apart by id); an empty table gives no rows; other columns are ignored."""
    tables = Tables(docs.sparkSession, "exact")
    named = tables.write(block_names(docs, tables, block_size, text_col, id_col, hash_sql), "named")
    tables.release("rows", *[k for k in list(tables.paths) if k.startswith(("names", "level", "pairs", "clashes"))])
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
