"""History windows of conversations from a stream of turns: keyed state that holds the last few turns of each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class History(StatefulProcessor):
    """Keeps the window latest user turns of a conversation, and forgets it when none has come for idle milliseconds (None: never)."""

    def __init__(self, window: int, idle: int | None):
        self.window, self.idle = window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("turns", "turn long, text string", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = [(int(t), x) for t, x in self.kept.get()]
        out = []
        for turn, said in sorted((int(t), x) for df in rows for t, x in zip(df["turn"], df["text"])):
            # a turn that comes late has the history of its own time, as far as it's still kept
            before = [k for k in kept if k[0] < turn][-max(1, self.window) :]
            history = [x for _, x in before][len(before) - min(self.window, len(before)) :]
            out.append((key[0], turn, history, before[-1][0] if before else None))
            kept = sorted([*kept, (turn, said)], key=lambda k: k[0])[-max(1, self.window) :]
        self.kept.put(kept)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "previous_turn"]).astype({"previous_turn": "Int64"})

    def close(self) -> None:
        pass


def streamed_history(turns: DataFrame, window: int = 3, idle: int | None = 24 * 3_600_000) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) to (conv_id, turn, history, previous_turn) of its user turns: the rows of with_history, each as soon as its turn has come.

    Turns of a conversation are taken in their order within a batch, and batches as they come. State is window turns for each
    conversation, dropped after idle milliseconds; the session must have STORE set. Null texts are kept as they are.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    user = turns.filter("role = 'user'").selectExpr("conv_id", "CAST(turn AS long) AS turn", "text")
    schema = f"conv_id {kind}, turn long, history array<string>, previous_turn long"
    return user.groupBy("conv_id").transformWithStateInPandas(History(window, idle), schema, "Append", "None" if idle is None else "ProcessingTime")
