"""Keyed running scan that stays correct and balanced when one key is huge.

Several operators are sequential per key: the position of a point inside its
series, the state of a build after each event, the dispatch decision of a
request.  ``Window.partitionBy(key)`` would put every row of a key into one
task, so a key holding a third of the data would run in a single task.

Instead the rows are range-partitioned on ``(key, order)``: Spark samples the
data and cuts a hot key into many partitions.  Each partition is scanned in
order (vectorised with numpy over Arrow batches) assuming every key segment
starts fresh.  Only the *first* key segment of a partition can continue a key
from the previous partition; for those rows the scan keeps the full
transition map (a finite-state machine is a function on K states, and
functions compose), so the true value is one lookup once the start state is
known.  The start states come from a summary of two rows per partition --
bounded by the partition count, not by the data -- resolved in one small
group and broadcast back.

The scanned rows are written once as a table under ``spark.checkpoint.dir``
so the partition ids the summary refers to are fixed and lineage is cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.session import checkpoint_dir

_PID = "_bt_pid"
_KIND = "_bt_kind"      # 0 data row, 1 first-key summary, 2 last-key summary
_HEAD = "_bt_head"      # row belongs to the partition's first key segment
_ST = "_bt_st"          # state before the row, assuming a fresh segment
_COMP = "_bt_comp"      # head rows: transition map from segment start
_CNT = "_bt_cnt"        # flagged rows before this one in the segment
_CODE = "_bt_code"
_FLAG = "_bt_flag"
_START = "_bt_start"
_OFF = "_bt_off"
_INTERNAL = [_PID, _KIND, _HEAD, _ST, _COMP, _CNT, _CODE, _FLAG, _START, _OFF]


def _same_adjacent(arr: pa.Array) -> np.ndarray:
    """Null-safe ``arr[i] == arr[i-1]`` for i >= 1."""
    n = len(arr)
    x, y = arr.slice(1, n - 1), arr.slice(0, n - 1)
    eq = pc.fill_null(pc.equal(x, y), False)
    both_null = pc.and_(pc.is_null(x), pc.is_null(y))
    return pc.or_(eq, both_null).to_numpy(zero_copy_only=False)


def _same_value(a: pa.Array, b: pa.Array) -> bool:
    """Null-safe equality of two one-row arrays."""
    if a.null_count and b.null_count:
        return True
    if a.null_count or b.null_count:
        return False
    return bool(pc.equal(a, b)[0].as_py())


def _scan_partitions(key_names, table: np.ndarray | None, initial: int):
    """Build the ``mapInArrow`` function for one scan."""
    fsm = table is not None
    k_states = table.shape[1] if fsm else 1
    ident = np.arange(k_states, dtype=np.int32)

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen = False
        in_head = True
        carry_key = None          # list of 1-row arrays
        carry_comp = ident
        carry_cnt = 0
        first_key = None
        head_comp = ident
        head_cnt = 0
        schema = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            schema = batch.schema
            key_cols = [batch.column(schema.get_field_index(k)) for k in key_names]
            codes = batch.column(schema.get_field_index(_CODE)).to_numpy(zero_copy_only=False)
            flags = batch.column(schema.get_field_index(_FLAG)).to_numpy(zero_copy_only=False)
            flags = flags.astype(np.int64)

            newseg = np.zeros(n, dtype=bool)
            newseg[0] = True
            for col in key_cols:
                if n > 1:
                    newseg[1:] |= ~_same_adjacent(col)
            cont = seen and all(_same_value(col.slice(0, 1), ck)
                                for col, ck in zip(key_cols, carry_key))
            if cont:
                newseg[0] = False
            breaks = np.flatnonzero(newseg[1:]) + 1
            first_break = int(breaks[0]) if len(breaks) else n
            idx = np.arange(n)
            seg_start = np.maximum.accumulate(np.where(newseg, idx, 0))

            # inclusive transition maps within each segment (Hillis-Steele)
            if fsm:
                comp = table[codes]
                d = 1
                while d < n:
                    src = idx - d
                    valid = src >= seg_start
                    prev = comp[np.where(valid, src, 0)]
                    joined = np.take_along_axis(comp, prev, axis=1)
                    comp = np.where(valid[:, None], joined, comp)
                    d <<= 1
                if cont:
                    comp[:first_break] = comp[:first_break][:, carry_comp]
                excl = np.empty_like(comp)
                excl[1:] = comp[:-1]
                excl[newseg] = ident
                if cont:
                    excl[0] = carry_comp
            cs = np.cumsum(flags)
            incl_cnt = cs - (cs[seg_start] - flags[seg_start])
            if cont:
                incl_cnt[:first_break] += carry_cnt
            excl_cnt = incl_cnt - flags

            head = np.zeros(n, dtype=bool)
            if (not seen) or (cont and in_head):
                head[:first_break] = True
            if not seen:
                first_key = [c.slice(0, 1) for c in key_cols]

            if fsm:
                st = pa.array(excl[:, initial].astype(np.int32), mask=head)
                values = pa.array(excl[head].ravel().astype(np.int32))
                offsets = np.concatenate(
                    [[0], np.cumsum(np.where(head, k_states, 0))]).astype(np.int32)
                comp_arr = pa.ListArray.from_arrays(
                    pa.array(offsets), values, type=pa.list_(pa.int32()),
                    mask=pa.array(~head))
            else:
                st = pa.array(np.zeros(n, dtype=np.int32))
                comp_arr = pa.nulls(n, type=pa.list_(pa.int32()))
            out = batch.append_column(_PID, pa.array(np.full(n, pid, dtype=np.int32)))
            out = out.append_column(_KIND, pa.array(np.zeros(n, dtype=np.int8)))
            out = out.append_column(_HEAD, pa.array(head))
            out = out.append_column(_ST, st)
            out = out.append_column(_COMP, comp_arr)
            out = out.append_column(_CNT, pa.array(excl_cnt.astype(np.int64)))
            yield out

            if head.any():
                h = first_break - 1
                head_comp = comp[h].copy() if fsm else ident
                head_cnt = int(incl_cnt[h])
            carry_key = [c.slice(n - 1, 1) for c in key_cols]
            carry_comp = comp[-1].copy() if fsm else ident
            carry_cnt = int(incl_cnt[-1])
            in_head = bool(head[-1])
            seen = True

        if not seen:
            return
        # two summary rows: first key with its head-segment map, last key with
        # the end state of its segment (valid when it is not the head segment)
        cols = []
        for field in schema:
            name = field.name
            if name in key_names:
                i = key_names.index(name)
                cols.append(pa.concat_arrays([first_key[i], carry_key[i]]))
            else:
                cols.append(pa.nulls(2, type=field.type))
        summary = pa.RecordBatch.from_arrays(cols, schema=schema)
        summary = summary.append_column(_PID, pa.array([pid, pid], type=pa.int32()))
        summary = summary.append_column(_KIND, pa.array([1, 2], type=pa.int8()))
        summary = summary.append_column(_HEAD, pa.array([True, in_head]))
        summary = summary.append_column(
            _ST, pa.array([None, int(carry_comp[initial]) if fsm else 0], type=pa.int32()))
        summary = summary.append_column(
            _COMP, pa.array([head_comp.tolist(), None], type=pa.list_(pa.int32())))
        summary = summary.append_column(
            _CNT, pa.array([head_cnt, carry_cnt], type=pa.int64()))
        yield summary

    return run


def _resolver(key_names, initial: int):
    """Chain partitions of the same key: start state and count offset per pid."""

    def same(a, b):
        for x, y in zip(a, b):
            if pd.isna(x) and pd.isna(y):
                continue
            if pd.isna(x) or pd.isna(y) or x != y:
                return False
        return True

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        # one pass over partitions in order; 2 summary rows per partition
        firsts = pdf[pdf[_KIND] == 1].sort_values(_PID).reset_index(drop=True)
        lasts = pdf[pdf[_KIND] == 2].sort_values(_PID).reset_index(drop=True)
        pids = firsts[_PID].to_numpy()
        first_keys = list(zip(*[firsts[k].tolist() for k in key_names]))
        last_keys = list(zip(*[lasts[k].tolist() for k in key_names]))
        comps, head_cnts = firsts[_COMP].tolist(), firsts[_CNT].to_numpy()
        single, last_st, last_cnt = (lasts[_HEAD].to_numpy(), lasts[_ST].tolist(),
                                     lasts[_CNT].to_numpy())
        n = len(pids)
        out_start = np.full(n, initial, dtype=np.int32)
        out_off = np.zeros(n, dtype=np.int64)
        end_state, end_cnt = initial, 0
        for i in range(n):
            if i > 0 and same(first_keys[i], last_keys[i - 1]):
                out_start[i], out_off[i] = end_state, end_cnt
            start, off = int(out_start[i]), int(out_off[i])
            if bool(single[i]):
                comp = comps[i]
                end_state = int(comp[start]) if comp is not None and len(comp) else initial
                end_cnt = off + int(head_cnts[i])
            else:
                end_state, end_cnt = int(last_st[i]), int(last_cnt[i])
        return pd.DataFrame({_PID: pd.Series(pids, dtype="int32"),
                             _START: pd.Series(out_start, dtype="int32"),
                             _OFF: pd.Series(out_off, dtype="int64")})

    return resolve


def _materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table under ``spark.checkpoint.dir``
    and read it back: lineage is cut, the partition ids stored in the rows
    stay fixed, and (unlike an RDD checkpoint of an uncached plan) the plan
    runs only once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def keyed_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
               code: Column | None = None, table: Sequence[Sequence[int]] | None = None,
               initial: int = 0, flag: Column | None = None,
               state_col: str | None = "state_before",
               count_col: str | None = "count_before",
               partitions: int | None = None, persist_input: bool = False) -> DataFrame:
    """Per key, in ascending ``order``: for every row the state of a finite-state
    machine *before* the row, and the number of earlier flagged rows.

    ``table[c][s]`` is the state reached from state ``s`` by a row with code
    ``c``; a null code leaves the state unchanged.  Every key starts in
    ``initial``.  ``flag`` (boolean) selects the rows that are counted.
    ``persist_input`` keeps the input between the range-bound sampling job
    and the scan; worth it only when the input plan is expensive (e.g. JSON
    parsing) -- for a table scan re-reading is cheaper than caching.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys, order = list(keys), list(order)
    tab = None
    if table is not None:
        tab = np.asarray(table, dtype=np.int32)
        ident = np.arange(tab.shape[1], dtype=np.int32)[None, :]
        tab = np.vstack([tab, ident])
        code_col = F.coalesce(code.cast("int"), F.lit(tab.shape[0] - 1))
    else:
        code_col = F.lit(0)
    flag_col = F.coalesce(flag.cast("long"), F.lit(0)) if flag is not None else F.lit(0)
    work = df.withColumn(_CODE, code_col.cast("int")).withColumn(_FLAG, flag_col.cast("long"))
    if persist_input:
        # range partitioning samples its input in a first job; keep the input
        # so that pass does not recompute an expensive upstream plan
        work = work.persist(StorageLevel.MEMORY_AND_DISK)
    if partitions:
        ranged = work.repartitionByRange(partitions, *keys, *order)
    else:
        # spark.sql.shuffle.partitions ranges; AQE may merge adjacent small
        # ones (order is kept), while a big hot key stays cut into many
        ranged = work.repartitionByRange(*keys, *order)
    ranged = ranged.sortWithinPartitions(*keys, *order)
    # summary rows carry nulls in every non-key column, so all are nullable
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True)
                               for f in work.schema.fields] + [
        T.StructField(_PID, T.IntegerType()),
        T.StructField(_KIND, T.ByteType()),
        T.StructField(_HEAD, T.BooleanType()),
        T.StructField(_ST, T.IntegerType()),
        T.StructField(_COMP, T.ArrayType(T.IntegerType())),
        T.StructField(_CNT, T.LongType()),
    ])
    scanned = _materialise(ranged.mapInArrow(_scan_partitions(keys, tab, initial), out_schema))
    if persist_input:
        work.unpersist()

    summary = (scanned.filter(F.col(_KIND) != 0)
               .select(*keys, _PID, _KIND, _HEAD, _ST, _COMP, _CNT)
               .withColumn("_bt_one", F.lit(1)))
    # O(partitions) rows computed from the written scan table, so every
    # consumer that re-evaluates it gets the same answer
    resolved = summary.groupBy("_bt_one").applyInPandas(
        _resolver(keys, initial),
        schema=f"{_PID} int, {_START} int, {_OFF} long")
    rows = scanned.filter(F.col(_KIND) == 0).join(F.broadcast(resolved), _PID, "left")
    head = F.col(_HEAD)
    result = rows
    if state_col and tab is not None:
        result = result.withColumn(
            state_col,
            F.when(head, F.element_at(F.col(_COMP), F.col(_START) + 1)).otherwise(F.col(_ST)))
    if count_col:
        result = result.withColumn(
            count_col, F.when(head, F.col(_CNT) + F.col(_OFF)).otherwise(F.col(_CNT)))
    return result.drop(*[c for c in _INTERNAL if c in result.columns])


def keyed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                     name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, skew-safe."""
    out = keyed_scan(df, keys, order, flag=F.lit(True), state_col=None,
                     count_col="_bt_rn", partitions=partitions)
    return out.withColumn(name, F.col("_bt_rn") + 1).drop("_bt_rn")
