"""Main texts of web pages: boilerplate goes by markup and by differences between neighbouring pages.

Pages of a host are put in the order of their URL paths; each is paired with the ones next to it. The text
lines of both are aligned by a longest common subsequence, and lines that both have are deleted.

Differencing alone is wrong in both directions here, so markup comes first (``page_lines``): lines in an
element or class for menus, adverts, notices, comments and the like are never text, lines in an article
always are, also if another page quotes them. Differencing decides about the lines that markup leaves open:
pages without an article element. A pair that shares nearly all of a page's text is a copy and tells nothing
about that page.

Shuffled are hashes of lines (64 bits, xxHash) with their page's host and place. What pages lose is broadcast
to their texts; only beyond a number of pages and lines are texts shuffled to it. The order of a host's pages is cut in blocks of bounded size, neighbours of a
border in both; a host with a third of all pages is numbered slice by slice.

Defined cases: null and empty markup has an empty text; pages without host (null URL, no "://") are not
paired; equal paths are put in the order of the whole URL, of page_id, then of the rows; repeated rows are
copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.page_lines import AWAY, UNSURE, lines_and_roles
from linkscore.operators.skew import row_number_in_group
from linkscore.storage import materialized, new_folder

#: Pages of a host in a block, and pages in a task, about.
BLOCK_PAGES, TASK_PAGES = 128, 2_000
#: Hosts with more pages are numbered slice by slice.
HOST_PAGES = 256
#: A page that shares so much of the text it would have is a copy.
COPY_SHARE = 0.9
#: Pages that lost lines, and lines lost, that are broadcast at most.
MAX_LOST_PAGES, MAX_LOST_LINES = 1_000_000, 10_000_000
#: Bytes of the table that an alignment is read off; longer pages are halved first.
TABLE_BYTES = 1 << 24


def _prefix_table(a: list, b: list) -> list[int]:
    """After each of a's first lines, the row of the LCS table as bits: a zero at j where the LCS with
    b's first j + 1 lines is longer than with its first j."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    return rows


def _lengths(a: list, b: list) -> np.ndarray:
    """LCS of a with b's first j lines, for every j."""
    row = _prefix_table(a, b)[-1]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(b)].astype(np.int64))])


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in a and b."""
    if not a or not b:
        return []
    if len(a) * len(b) > 8 * TABLE_BYTES and len(a) > 1:
        half = len(a) // 2
        before, behind = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int((before + behind).argmax())
        second = common_lines(a[half:], b[cut:])
        return common_lines(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in second]
    rows = _prefix_table(a, b)
    i, j, found = len(a), len(b), []
    while i and j:
        low = (1 << j) - 1
        if (rows[i] & low).bit_count() == (rows[i - 1] & low).bit_count():
            i -= 1
            continue
        zeros = ~rows[i] & low
        j = zeros.bit_length() - 1
        i -= 1
        found.append((i, j))
    return found[::-1]


def shared_lines(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Which lines of each page are in the longest common subsequence; lines of only one are left out first."""
    sides = np.zeros(len(a), bool), np.zeros(len(b), bool)
    in_a, in_b = set(a), set(b)
    of_a, of_b = [i for i, x in enumerate(a) if x in in_b], [j for j, y in enumerate(b) if y in in_a]
    for i, j in common_lines([a[i] for i in of_a], [b[j] for j in of_b]):
        sides[0][of_a[i]] = sides[1][of_b[j]] = True
    return sides


def parsed_lines(pages: DataFrame) -> DataFrame:
    """page_id, url, ``text`` by markup alone, and of all lines the hashes, sizes and roles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts, keys, sizes, roles = [], [], [], []
                for html in batch.column("html").to_pylist():
                    lines, role = lines_and_roles(html)
                    texts.append("\n".join(t for t, r in zip(lines, role) if r != AWAY))
                    keys.append(np.array([xxhash.xxh3_64_intdigest(t) for t in lines], np.uint64).view(np.int64))
                    sizes.append([len(t) for t in lines])
                    roles.append(role)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
                        pa.array(roles, pa.list_(pa.int8())),
                    ],
                    ["page_id", "url", "text", "keys", "sizes", "roles"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, keys array<long>, sizes array<int>, roles array<byte>"
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(each, schema)


def _of_block(pages: list[dict]) -> Iterator[tuple[int, list[int]]]:
    """Rows of a block and the numbers of their lines (among those of the text) that a neighbour has."""
    shared = [np.zeros(len(p["keys"]), bool) for p in pages]
    for k in range(len(pages) - 1):
        if pages[k + 1]["_rank"] != pages[k]["_rank"] + 1:
            continue
        sides = shared_lines(pages[k]["keys"], pages[k + 1]["keys"])
        for n, side in zip((k, k + 1), sides):
            text, sizes = np.array(pages[n]["roles"]) != AWAY, np.array(pages[n]["sizes"])
            if sizes[side & text].sum() < COPY_SHARE * sizes[text].sum():
                shared[n] |= side
    for page, side in zip(pages, shared):
        roles = np.array(page["roles"])
        number = np.cumsum(roles != AWAY) - 1
        lost = number[side & (roles == UNSURE)]
        if page["_own"] and len(lost):
            yield page["_row"], lost.tolist()


def lines_of_neighbours(parsed: DataFrame) -> DataFrame:
    """(_row, lost): numbers of the text's lines that the page before or behind on the host has, too."""
    url = F.col("url")
    placed = parsed.select(
        "_row", "page_id", "url", "keys", "sizes", "roles",
        F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
    ).filter("host != ''")
    order = [F.col(c) for c in ("path", "url", "page_id", "_row")]
    ranked = row_number_in_group(placed, ["host"], order, "_rank", HOST_PAGES)
    block = F.floor((F.col("_rank") - 1) / BLOCK_PAGES)
    place = F.col("_rank") % BLOCK_PAGES
    # The last page of a block is also next to the first one of the following block, and the other way round.
    other = F.when(place == 0, block + 1).when(place == 1, block - 1)
    blocks = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")),
                                     F.when(other >= 0, F.struct(other.alias("block"), F.lit(False).alias("own")))))
    dealt = ranked.select("_row", "host", "_rank", "keys", "sizes", "roles", F.explode(blocks).alias("b"))
    tasks = max(1, parsed.count() // TASK_PAGES)
    dealt = dealt.select(
        "_row", "host", "_rank", "keys", "sizes", "roles", F.col("b.block").alias("_block"), F.col("b.own").alias("_own"),
        F.pmod(F.xxhash64("host", "b.block"), F.lit(tasks)).alias("_task"),
    )

    def each(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("host", "ascending"), ("_block", "ascending"), ("_rank", "ascending")]).to_pylist()
        found, a = [], 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or (rows[k]["host"], rows[k]["_block"]) != (rows[a]["host"], rows[a]["_block"]):
                found += _of_block(rows[a:k])
                a = k
        return pa.table({
            "_row": pa.array([r for r, _ in found], pa.int64()),
            "lost": pa.array([x for _, x in found], pa.list_(pa.int32())),
        })

    return dealt.groupBy("_task").applyInArrow(each, "_row long, lost array<int>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages``: lines of the main text, in page order."""
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "lines")
    numbered = parsed_lines(pages).withColumn("_row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(folder)  # texts make up most of it
    parsed = spark.read.schema(numbered.schema).parquet(folder)
    lost = materialized(lines_of_neighbours(parsed), "lost")
    n_pages, n_lines = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lost")), F.lit(0))).first()
    if n_pages <= MAX_LOST_PAGES and n_lines <= MAX_LOST_LINES:
        lost = F.broadcast(lost)
    lines = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("lost", k))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return parsed.select("_row", "page_id", "url", "text").join(lost, "_row", "left").select(
        "page_id", "url", text.alias("text")
    )


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For pages whose text is in one article of headings and paragraphs with plain references, as generated.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT page_id, url, list_filter(list_transform(
      regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'),
                            '(?:</?(?:p|h1)>|</?b>|<br>)+'),
      lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x,
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '[\s\x{A0}]+', ' ', 'g'))),
    lambda x: x <> '') AS parts
  FROM pages)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text,
  length(array_to_string(parts, chr(10)))::BIGINT AS n_chars
FROM lines
"""
