"""Keeping a token store up to date from a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.operators.tokens import update_token_store


def stream_token_store(
    stream: DataFrame, text_col: str, store: str, checkpoint: str, model: str = "word"
) -> None:
    """Tokenise the unseen texts of every micro-batch into the store.

    A batch that is repeated after a failure finds its texts already stored.
    """
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, _: update_token_store(batch, text_col, store, model)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
