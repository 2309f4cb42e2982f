"""Records that are identical but for formatting (problem 3).

Method: every record is put into one canonical text, the canonical records are range-partitioned
and sorted (Spark's external sort spills to disk), and adjacent runs are scanned, comparing full
keys. Range bounds cover (key, id), so a record with very many copies is spread over several
partitions. The scan keeps one key, one id and one count, whatever the size of its partition: rows
leave as they come, with the first id of their run, and a run's length leaves at its end. Only the
first run of a partition can have begun in an earlier one; it is joined up from one summary of the
first and one of the last run of each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import partitions_of, stored
from ..sources.tables import table

# Punctuation that may surround a value, and all blanks.
_EDGE = ".,;:!'\"`()<>[]{}«»“”‘’…،؛"
_BLANK = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def _bare(value: Column) -> Column:
    """Lower case, no white space, no surrounding punctuation; missing becomes ''."""
    return F.btrim(F.lower(F.translate(F.coalesce(value, F.lit("")), _BLANK, "")), F.lit(_EDGE))


def canonical_handle(value: Column) -> Column:
    """A handle without ``@`` and closing slashes; inner dots, underscores and hyphens stay."""
    return _handle(_bare(value))


def _handle(text: Column) -> Column:
    """``canonical_handle`` of a bare text."""
    return F.rtrim(F.ltrim(text, F.lit("@" + _EDGE)), F.lit("/" + _EDGE))


def _address(text: Column) -> Column:
    """``canonical_address`` of a bare text, which should be a column: it is used twice."""
    plain = F.regexp_replace(text, "^(?:https?:/*)?(?:www\\.)?", "")
    head = F.rtrim(F.regexp_replace(F.substring_index(plain, "?", 1), "/{2,}", "/"), F.lit("/"))
    query = F.regexp_extract(text, "\\?(.*)$", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(text.contains("?") & (query != "") & (params != ""), F.concat(head, F.lit("?"), params)).otherwise(head)


def canonical_address(value: Column) -> Column:
    """An address without scheme, ``www.`` and doubled or closing slashes, its parameters sorted."""
    return _address(_bare(value))


def raw_field(raw: Column, name: str) -> Column:
    """Field ``name`` of a record in text form, as JSON member or ``name = value`` line."""
    member = f"""(?is)"{name}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)\""""
    line = f"(?im)^[ \\t]*{name}[ \\t]*[:=][ \\t]*(.*)$"
    quoted, plain = F.regexp_extract(raw, member, 1), F.regexp_extract(raw, line, 1)
    is_json = raw.rlike("^\\s*\\{")
    unescaped = F.regexp_replace(F.regexp_replace(quoted, "\\\\[nrt]", " "), "\\\\(.)", "$1")
    return F.when(is_json, unescaped).otherwise(plain)


def canonical_records(
    df: DataFrame, row_id: str, handle: str = "username", profile: str = "instagram_url", website: str = "website",
    raw: str = "raw", raw_names: tuple[str, str, str] = ("username", "instagramurl", "website"),
) -> DataFrame:
    """``id, key``: each record's full key as one text; '' for an all-blank record.

    A field that is blank in its column is read from the text form, where there is one. Each step
    is a projection of its own, so that no expression is evaluated twice for a row.
    """
    columns = (handle, profile, website)
    has_raw = F.col(raw).isNotNull() & (F.col(raw) != "")
    found = df.select(F.col(row_id).cast("long").alias("id"), *[_bare(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)], F.when(has_raw, F.col(raw)).alias("raw"))
    found = found.select("id", *[
        F.when((F.col(f"c{i}") == "") & F.col("raw").isNotNull(), _bare(raw_field(F.col("raw"), name))).otherwise(F.col(f"c{i}")).alias(f"c{i}")
        for i, name in enumerate(raw_names)])
    found = found.select("id", _handle(F.col("c0")).alias("c0"), _address(F.col("c1")).alias("c1"), _address(F.col("c2")).alias("c2"))
    blank = (F.col("c0") == "") & (F.col("c1") == "") & (F.col("c2") == "")
    return found.select("id", F.when(blank, "").otherwise(F.concat_ws("\x01", "c0", "c1", "c2")).alias("key"))


_SCANNED = "id long, keep long, part int, n long, edge string"
_SCAN_TYPES = pa.schema([("id", pa.int64()), ("keep", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("edge", pa.string())])


def _scan(batches):
    """Adjacent runs of one sorted partition, batch by batch.

    Two kinds of rows leave: ``id, keep, part`` for a row, where ``part`` is set in the first run only,
    and ``keep, n`` for a run; the first and the last run of the partition keep their key as ``edge``,
    and ``part`` with it. Between batches one key, its first id and its length are held.
    """
    part = TaskContext.get().partitionId()
    key, keep, length, first = None, 0, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("id")).to_numpy()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = key is None or keys[0].as_py() != key
        starts = np.flatnonzero(new)
        # Rows before the first start go on with the run of the batch before.
        run = np.cumsum(new) - 1
        kept = np.where(run < 0, keep, ids[starts[np.maximum(run, 0)]] if len(starts) else keep)
        still = first and key is not None
        in_first = (run < 0) & still if key is not None else run == 0
        yield _rows(ids, kept, np.where(in_first, part, -1))
        bounds = np.append(starts, n)
        closed_keep, closed_n = [], []
        if len(starts) and key is not None:
            # The run held from before ends here.
            if first:
                yield _run(keep, length + int(starts[0]), part, key)
                first = False
            else:
                closed_keep, closed_n = [keep], [length + int(starts[0])]
        lengths = np.diff(bounds)
        if len(starts) > 1:
            whole = slice(0, len(starts) - 1)
            if key is None:
                yield _run(int(ids[starts[0]]), int(lengths[0]), part, keys[int(starts[0])].as_py())
                first = False
                whole = slice(1, len(starts) - 1)
            closed_keep += ids[starts[whole]].tolist()
            closed_n += lengths[whole].tolist()
        if closed_keep:
            m = len(closed_keep)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(closed_keep, pa.int64()), pa.nulls(m, pa.int32()), pa.array(closed_n, pa.int64()), pa.nulls(m, pa.string())], schema=_SCAN_TYPES)
        if len(starts):
            key, keep, length = keys[int(starts[-1])].as_py(), int(ids[starts[-1]]), int(lengths[-1])
        else:
            length += n
    if key is not None:
        yield _run(keep, length, part if first else -1, key)


def _rows(ids: np.ndarray, kept: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(kept.astype(np.int64)), pa.array(part.astype(np.int32), mask=part < 0), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], schema=_SCAN_TYPES)


def _run(keep: int, n: int, part: int, key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.array([keep], pa.int64()), pa.array([part if part >= 0 else None], pa.int32()), pa.array([n], pa.int64()), pa.array([key])], schema=_SCAN_TYPES)


def scan_runs(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, keep_id`` of each row of ``id, key`` with a non-blank key, ``keep_id, copies`` of each record).

    ``keep_id`` is the smallest id of the rows with an equal key, ``copies`` how many there are.
    Rows whose key is null or '' are no record and give no row; a null id counts as no row; repeated
    ids are rows of their own; an empty input gives an empty result. The keys are written once, so
    that sampling the range bounds does not make them again.
    """
    spark = keyed.sparkSession
    keyed = stored(keyed.select("id", "key"), "keys").where("key <> '' and id is not null").select("key", "id")
    ordered = keyed.repartitionByRange(partitions_of(spark), "key", "id").sortWithinPartitions("key", "id")
    scanned = stored(ordered.mapInArrow(_scan, _SCANNED), "runs")
    # Two rows at most for each partition of the sort. Full keys are compared.
    edges = scanned.where("id is null and edge is not null")
    whole = edges.groupBy("edge").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("copies"))
    # One number for each partition, whatever the length of the keys.
    begun = edges.where("part is not null").join(whole, "edge").select("part", "keep_id")
    rows = scanned.where("id is not null").select("id", "keep", "part").join(F.broadcast(begun), "part", "left")
    inner = scanned.where("id is null and edge is null").select(F.col("keep").alias("keep_id"), F.col("n").alias("copies"))
    return rows.select("id", F.coalesce("keep_id", "keep").alias("keep_id")), inner.unionByName(whole.select("keep_id", "copies"))


def collapse_copies(keyed: DataFrame) -> DataFrame:
    """``keep_id, copies``: one row per record with its representative and the exact number of its copies."""
    return scan_runs(keyed)[1]


def copies_of(keyed: DataFrame) -> DataFrame:
    """``id, keep_id``: every row with the representative of its record."""
    return scan_runs(keyed)[0]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    rows = copies_of(canonical_records(table(spark, root, "lead_import"), "import_id"))
    return rows.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    """One row per record: its representative and the exact number of its copies."""
    return collapse_copies(canonical_records(table(spark, root, "lead_import"), "import_id"))


# ---- the same in SQL ----

_S_EDGE = r"""[.,;:!''"`()<>\[\]{}«»“”‘’…،؛]"""
_S_BLANK = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _s_bare(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace(coalesce({x}, ''), '{_S_BLANK}+', '', 'g')), '^{_S_EDGE}+|{_S_EDGE}+$', '', 'g')"


def _s_raw(name: str) -> str:
    member = rf"""regexp_replace(regexp_replace(regexp_extract(raw, '(?is)"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), '\\[nrt]', ' ', 'g'), '\\(.)', '\1', 'g')"""
    line = rf"regexp_extract(raw, '(?im)^[ \t]*{name}[ \t]*[:=][ \t]*(.*)$', 1)"
    return rf"(CASE WHEN regexp_matches(raw, '^\s*\{{') THEN {member} ELSE {line} END)"


def _s_address(x: str) -> str:
    plain = rf"regexp_replace({x}, '^(?:https?:/*)?(?:www\.)?', '')"
    head = rf"regexp_replace(regexp_replace(split_part({plain}, '?', 1), '/{{2,}}', '/', 'g'), '/+$', '')"
    params = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({x}, '\?(.*)$', 1), '&'), lambda p: p <> '')), '&')"
    return f"(CASE WHEN contains({x}, '?') AND {params} <> '' THEN {head} || '?' || {params} ELSE {head} END)"


_FIELDS = (("username", "username"), ("instagram_url", "instagramurl"), ("website", "website"))
_S_KEYS = f"""WITH a AS (SELECT import_id, nullif(raw, '') AS raw, {', '.join(f'{_s_bare(c)} AS c{i}' for i, (c, _) in enumerate(_FIELDS))} FROM lead_import),
b AS (SELECT import_id, {', '.join(f"CASE WHEN c{i} = '' AND raw IS NOT NULL THEN {_s_bare(_s_raw(n))} ELSE c{i} END AS c{i}" for i, (_, n) in enumerate(_FIELDS))} FROM a),
c AS (SELECT import_id, regexp_replace(regexp_replace(c0, '^(?:@|{_S_EDGE})+', ''), '(?:/|{_S_EDGE})+$', '') AS c0, {_s_address('c1')} AS c1, {_s_address('c2')} AS c2 FROM b),
k AS (SELECT import_id, min(import_id) OVER (PARTITION BY c0, c1, c2) AS keep_id FROM c WHERE c0 <> '' OR c1 <> '' OR c2 <> '')"""

QUERIES = {"p3_found": p3_found, "p3_records": p3_records}
SQL = {
    "p3_found": f"{_S_KEYS} SELECT keep_id, import_id AS copy_id FROM k WHERE import_id <> keep_id",
    "p3_records": f"{_S_KEYS} SELECT keep_id, count(*) AS copies FROM k GROUP BY keep_id",
}
