"""Chat formatting by minimum-cost role repair.

A conversation is legal if an optional system message is followed by user and
assistant messages in turn and an assistant message ends it.  Dynamic programming
over the automaton of the last role chooses, for each turn, to keep it, to relabel
it, to merge it into the message before, or to put an empty message of the missing
role before it.  Costs of turns compose as (min, +) matrices, so a conversation of
any length is cut into blocks: each block gives its matrix, the blocks' matrices
are chained, and each block is then repaired between its known end states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the last message's role.
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, UNKNOWN, MERGE, INSERT = 3.0, 1.0, 1.0, 2.0
BLOCK_BITS = 11  # 2048 turns
INF = np.inf

# (state before, role of the turn) -> (cost, action, inserted role)
_STEP: dict[tuple[int, int], tuple[float, str, str]] = {
    (START, SYSTEM): (0.0, "keep", ""), (START, USER): (0.0, "keep", ""), (START, ASSISTANT): (INSERT, "keep", "user"),
    (SYSTEM, SYSTEM): (MERGE, "merge", ""), (SYSTEM, USER): (0.0, "keep", ""), (SYSTEM, ASSISTANT): (INSERT, "keep", "user"),
    (USER, USER): (MERGE, "merge", ""), (USER, ASSISTANT): (0.0, "keep", ""),
    (ASSISTANT, USER): (0.0, "keep", ""), (ASSISTANT, ASSISTANT): (MERGE, "merge", ""),
}
#: Cost of ending in a state (an empty answer is put after an open question).
_END = np.array([0.0, 0.0, INSERT, 0.0])


def turn_matrix(role: str | None) -> np.ndarray:
    """Cost from each state to each state by a turn labelled ``role``."""
    m = np.full((4, 4), INF)
    for (state, to), (cost, _, _) in _STEP.items():
        label = 0.0 if role == ROLES[to - 1] else RELABEL if role in ROLES else UNKNOWN
        m[state, to] = cost + label
    return m


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(1)


_IDENTITY = np.where(np.eye(4) > 0, 0.0, INF)


def best_path(matrices: list[np.ndarray], first: int, last: int | None) -> list[int]:
    """The states before and after each matrix on the cheapest path from ``first``
    to ``last`` (None: to where ending is cheapest); the lower state wins a tie."""
    costs = [np.where(np.arange(4) == first, 0.0, INF)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(0))
    state = int(np.argmin(costs[-1] + _END)) if last is None else last
    path = [state]
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        state = int(np.argmin(before + m[:, state]))
        path.append(state)
    return path[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n"


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each turn of ``conversations(conv_id, turn, role, text)``: conv_id,
    turn, label (as given), role (as repaired), action (keep or merge), inserted
    (role of an empty message put before, else empty), closed (role of one put after
    the last turn, else empty), message long (number of its message in the
    conversation, from 0, empty ones included), at long (place in the order of turns),
    rendered (its piece of the rendered conversation: in the order of ``at`` the
    pieces make up the whole).

    Turns are ordered by turn (nulls last), label and text.  Null labels and labels
    outside the three roles cost less to relabel; null texts are empty; a null
    conv_id is a conversation of its own; repeated turns are turns; ties keep any
    order, the same for role and text; an empty table gives no rows; other columns are
    ignored.
    """
    known = F.lower(F.trim("role"))
    rows = conversations.select("conv_id", "turn", F.col("role").alias("label"), known.alias("_role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("label"), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    rows = stage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_at", BLOCK_BITS)), "turns")
    same = ["conv_id", "_block"]

    def parts(df: pd.DataFrame):
        """A block's conversations; a null id stays None (not NaN, which is a number)."""
        for conv, part in df.sort_values("_at").groupby("conv_id", sort=False, dropna=False):
            yield None if pd.isna(conv) else conv, part

    def blocks(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, part in parts(df):
            m = _IDENTITY
            for role in part["_role"]:
                m = _compose(m, turn_matrix(role))
            out.append((conv, part["_block"].iloc[0], m.ravel().tolist()))
        return pd.DataFrame(out, columns=["conv_id", "_block", "m"])

    spans = rows.groupBy("conv_id").agg(F.min("_block").alias("lo"), F.max("_block").alias("hi")).where("lo < hi").select("conv_id")
    # nulls match nulls here: the null conversation may be the long one
    long = rows.select(*same, "_at", "_role").alias("r").join(spans.alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")), "left_semi")
    matrices = long.withColumn("conv_id", F.col("conv_id").cast("string")).groupBy("_block").applyInPandas(blocks, "conv_id string, _block long, m array<double>")

    def chain(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("_block")
        path = best_path([np.array(m).reshape(4, 4) for m in df["m"]], START, None)
        return pd.DataFrame({"conv_id": df["conv_id"].to_numpy(), "_block": df["_block"].to_numpy(), "_from": path[:-1], "_to": path[1:], "_last": np.arange(len(df)) == len(df) - 1})

    # A group has one row of 16 numbers for each 2048 turns of a conversation.
    ends = stage(matrices.groupBy("conv_id").applyInPandas(chain, "conv_id string, _block long, _from int, _to int, _last boolean"), "turn-blocks")

    def steps(part: pd.DataFrame) -> list[tuple[int, str, str, int]]:
        """For the turns of a conversation in a block: state after it, action, inserted
        role, and its message's number less the messages of the blocks before."""
        first, out, number = part.iloc[0], [], -1
        inner = pd.notna(first["_from"])
        path = best_path([turn_matrix(r) for r in part["_role"]], int(first["_from"]) if inner else START, int(first["_to"]) if inner else None)
        for before, after in zip(path[:-1], path[1:], strict=True):
            _, action, inserted = _STEP[before, after]
            number += (action == "keep") + bool(inserted)
            out.append((after, action, inserted, number))
        return out

    def number(df: pd.DataFrame) -> pd.DataFrame:
        out = [(conv, part["_block"].iloc[0], steps(part)[-1][3] + 1) for conv, part in parts(df)]
        return pd.DataFrame(out, columns=["conv_id", "_block", "n"])

    def mend(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, part in parts(df):
            taken, first, n = steps(part), part.iloc[0], len(part)
            inner = pd.notna(first["_from"])
            before = int(first["_before"]) if pd.notna(first["_before"]) else 0
            for k, (turn, label, text, at) in enumerate(zip(part["turn"], part["label"], part["text"], part["_at"], strict=True)):
                state, action, inserted, message = taken[k]
                closed = "assistant" if k == n - 1 and (not inner or bool(first["_last"])) and state == USER else ""
                role = ROLES[state - 1]
                piece = (render(inserted, "") if inserted else "") + (f"{text}\n" if action == "merge" else render(role, text)) + (render(closed, "") if closed else "")
                out.append((conv, turn, label, role, action, inserted, closed, message + before, at, piece))
        return pd.DataFrame(out, columns=["conv_id", "turn", "label", "role", "action", "inserted", "closed", "message", "at", "rendered"])

    keyed = rows.withColumn("conv_id", F.col("conv_id").cast("string")).withColumn("turn", F.col("turn").cast("string"))
    join = lambda right, how: keyed.alias("k").join(right.alias("e"), F.col("k.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("k._block") == F.col("e._block")), how)
    counts = join(ends, "inner").select("k.*", "_from", "_to").groupBy("_block").applyInPandas(number, "conv_id string, _block long, n long")
    # One row for each 2048 turns here too.
    so_far = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("conv_id", "_block", F.coalesce(so_far, F.lit(0)).alias("_before"))
    known = ends.alias("x").join(before.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x._block") == F.col("y._block"))).select("x.*", "_before")
    joined = join(stage(known, "turn-ends"), "left").select("k.*", "_from", "_to", "_last", "_before")
    types = dict(conversations.dtypes)
    done = joined.groupBy("_block").applyInPandas(mend, "conv_id string, turn string, label string, role string, action string, inserted string, closed string, message long, at long, rendered string")
    return done.withColumn("conv_id", F.col("conv_id").cast(types["conv_id"])).withColumn("turn", F.col("turn").cast(types["turn"]))


def messages(repaired: DataFrame) -> DataFrame:
    """The rendered sequences of ``repair``, a row for each message: conv_id, message,
    part, role, rendered.  A message merged from very many turns comes in parts of 2048
    turns at most; in the order of message and part the rows make up a conversation."""
    blank = lambda c: F.when(F.col(c) == "", F.lit("")).otherwise(F.concat(F.lit("<|"), F.col(c), F.lit("|>\n\n")))
    own = F.substr("rendered", F.length(blank("inserted")) + 1, F.length("rendered") - F.length(blank("inserted")) - F.length(blank("closed")))
    row = lambda shift, role, text: F.struct((F.col("message") + shift).alias("message"), role.alias("role"), text.alias("text"))
    pieces = F.array_compact(F.array(F.when(F.col("inserted") != "", row(-1, F.col("inserted"), blank("inserted"))), row(0, F.col("role"), own), F.when(F.col("closed") != "", row(1, F.col("closed"), blank("closed")))))
    each = repaired.select("conv_id", "at", F.shiftright("at", BLOCK_BITS).alias("part"), F.explode(pieces).alias("p")).select("conv_id", "at", "part", "p.*")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return each.groupBy("conv_id", "message", "part").agg(F.first("role").alias("role"), joined.alias("rendered"))


def op5_chat(spark, sf_dir):
    """Every conversation repaired and rendered."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
