"""The focus of conversations as a stream of turns with state by project and a timer that forgets it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import conversation as C

OUT = f"project string, seq long, question string, intent string, expired boolean, {C.TURN}"
STATE = f"asked_ms long, intent string, focus {C.FACTS}"


def conversation_focus(turns: DataFrame, max_age_ms: int = C.MAX_AGE_MS) -> DataFrame:
    """Turns as from ``operators.conversation.focus``, as they come in; a row with ``expired`` when a project's focus is forgotten.

    Age is told by the turns' own time. A timer of processing time, set anew by every turn, removes the state of projects that ask
    nothing any more, so state grows with the projects of the last ``max_age_ms`` only.
    """

    def step(key: tuple, batches, state: GroupState):
        columns = ["project", "seq", "question", "intent", "expired", "used", "previous_intent", "prior", "focus"]
        if state.hasTimedOut:
            prior = [dict(zip(("kind", "value", "source"), f, strict=True)) for f in state.get[2]]
            before = state.get[1]
            state.remove()
            yield pd.DataFrame([(key[0], None, None, None, True, False, before, prior, [])], columns=columns)
            return
        kept: dict = {}
        if state.exists:
            asked_ms, intent, focus = state.get
            kept = {"asked_ms": asked_ms, "intent": intent, "focus": [dict(zip(("kind", "value", "source"), f, strict=True)) for f in focus]}
        rows = pd.concat(list(batches)).sort_values(["asked_ms", "seq"], kind="stable")
        out = []
        for row in rows.to_dict("records"):
            row["facts"] = [f if isinstance(f, dict) else f.asDict() for f in ([] if row["facts"] is None else row["facts"])]
            out.append((key[0], row["seq"], row["question"], row["intent"], False, *C.turn(kept, row, max_age_ms)))
        state.update((kept["asked_ms"], kept["intent"], [(f["kind"], f["value"], f["source"]) for f in kept["focus"]]))
        state.setTimeoutDuration(max_age_ms)
        yield pd.DataFrame(out, columns=columns)

    rows = C.prepared(turns).withColumn("project", F.col("project").cast("string")).withColumn("seq", F.col("seq").cast("long"))
    out = rows.groupBy("project").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("answer", C.answer(F.col("question"), F.col("intent"), F.col("used"), F.col("prior")))
