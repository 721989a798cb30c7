"""Flags over the decision stream: what each feature's decisions say about its flags, kept as state.

The state of a feature is what its conditions read: whether it was decided again, which of its
accepted ids a back-check found to be another compound or a class, and its last few decisions of each kind. So
it doesn't grow with the stream. A row comes out whenever a feature's decisions do; the last of a feature counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Decisions of a kind that are remembered of a feature.
HISTORY = 5
_STATE = "redecided boolean, conflicts array<string>, classes array<string>, n long"
OUTPUT = f"ordinal long, {_STATE}, history string"
#: Spark keeps the state of such processors in RocksDB.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FlagStates(StatefulProcessor):
    """Folds a feature's decisions (seq, action, db, id, verdict, db_resolution, held) into its state, in the order of seq within a trigger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)
        self.history = handle.getMapState("history", "action string", "seqs array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        redecided, conflicts, classes, n = self.state.get() if self.state.exists() else (False, [], [], 0)
        conflicts, classes, new = set(conflicts), set(classes), {}
        for found in rows:
            n += len(found)
            redecided = redecided or bool(found["action"].isin(["accept", "exclude"]).any())
            checks = found[(found["action"] == "backcheck") & found["held"].fillna(False).astype(bool)]
            of = lambda x: set((x["db"] + "=" + x["id"]).tolist())
            conflicts |= of(checks[checks["verdict"] == "conflict"])
            classes |= of(checks[(checks["verdict"] == "class-level") | (checks["db_resolution"] == "class")])
            for action, seqs in found.groupby("action")["seq"]:
                new[action] = sorted([*new.get(action, []), *seqs.tolist()])[-HISTORY:]
        for action, seqs in new.items():
            before = list(self.history.getValue((action,))[0]) if self.history.containsKey((action,)) else []
            self.history.updateValue((action,), (sorted([*before, *seqs])[-HISTORY:],))
        self.state.update((redecided, sorted(conflicts), sorted(classes), n))
        said = ";".join(sorted(f"{k[0]}:{','.join(map(str, v[0]))}" for k, v in self.history.iterator()))
        yield pd.DataFrame({"ordinal": [key[0]], "redecided": [redecided], "conflicts": [sorted(conflicts)], "classes": [sorted(classes)], "n": [n], "history": [said]})

    def close(self) -> None:
        pass


def states(decisions: DataFrame, held: DataFrame) -> DataFrame:
    """OUTPUT of a stream of decisions; held: ordinal, db, id of accepted ids, as they stand. Decisions without a feature or an action count for nothing."""
    own = held.select("ordinal", "db", "id").withColumn("held", F.lit(True))
    rows = decisions.where("ordinal is not null and action is not null").select("ordinal", "seq", "action", "db", "id", "verdict", "db_resolution").join(own, ["ordinal", "db", "id"], "left")
    return rows.groupBy("ordinal").transformWithStateInPandas(statefulProcessor=FlagStates(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def latest(found: DataFrame) -> DataFrame:
    """Of rows that came out of states(), the last of each feature."""
    best = F.max(F.struct("n", "redecided", "conflicts", "classes", "history")).alias("x")
    return found.groupBy("ordinal").agg(best).select("ordinal", "x.*")


def as_decisions(found: DataFrame) -> DataFrame:
    """The few decisions that say what the states do: ordinal, action, db, id, verdict, db_resolution, for the same conditions as read the whole log."""
    none = F.lit(None).cast("string")
    again = found.where("redecided").select("ordinal", F.lit("accept").alias("action"), none.alias("db"), none.alias("id"), none.alias("verdict"))
    check = lambda c, v: found.select("ordinal", F.explode(c).alias("x")).select("ordinal", F.lit("backcheck").alias("action"), F.substring_index("x", "=", 1).alias("db"), F.regexp_replace("x", "^[^=]*=", "").alias("id"), F.lit(v).alias("verdict"))
    return again.unionByName(check("conflicts", "conflict")).unionByName(check("classes", "class-level")).withColumn("db_resolution", none)
