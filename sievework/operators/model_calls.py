"""Calls of a model from a table: a function from prompt to text, called with bounded concurrency, retried, and remembered.

The function is the caller's and runs where the rows are; without one the rows keep what they have. Each task holds WINDOW
rows, calls a prompt that several of them share once, and gives the rows back in their order. Replies must be written (see
sources.cuts) before they are used twice: a task that is repeated calls again.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls at a time in one task; rows held while they wait; prompts remembered by a task.
CONCURRENCY, WINDOW, REMEMBERED = 4, 64, 4096
#: Calls of a prompt before it is given up, and the wait before the second, which doubles.
TRIES, WAIT_SECONDS = 3, 0.5


class Caller:
    """Replies as (text, error, calls); the memo holds replies only, so that an error is tried again for a later row."""

    def __init__(self, call: Callable[[str], str | None], tries: int, wait: float, retry: tuple[type[BaseException], ...], remembered: int):
        self.call, self.tries, self.wait, self.retry, self.room = call, tries, wait, retry, remembered
        self.memo: OrderedDict[str, str | None] = OrderedDict()

    def ask(self, prompt: str) -> tuple[str | None, str | None, int]:
        for attempt in range(1, self.tries + 1):
            try:
                return self.call(prompt), None, attempt
            except self.retry as error:
                if attempt == self.tries:
                    return None, f"{type(error).__name__}: {error}"[:200], attempt
                time.sleep(self.wait * 2 ** (attempt - 1))
            except Exception as error:  # not worth another try: the row tells of it, the others go on
                return None, f"{type(error).__name__}: {error}"[:200], attempt
        return None, "no tries", 0

    def replies(self, prompts: list[str | None], pool: ThreadPoolExecutor) -> list[tuple[str | None, str | None, int]]:
        new = list(dict.fromkeys(p for p in prompts if p is not None and p not in self.memo))
        made = dict(zip(new, pool.map(self.ask, new), strict=True))
        out = []
        for p in prompts:
            if p is None:
                out.append((None, None, 0))
            elif p in made:
                out.append(made[p])
                made[p] = (*made[p][:2], 0)
            else:
                out.append((self.memo[p], None, 0))
        for p, (text, error, _) in made.items():
            if error is None:
                self.memo[p] = text
                if len(self.memo) > self.room:
                    self.memo.popitem(last=False)
        return out


def with_replies(
    df: DataFrame, call: Callable[[str], str | None] | None, prompt: str = "prompt", into: str = "reply", concurrency: int = CONCURRENCY, window: int = WINDOW,
    tries: int = TRIES, wait: float = WAIT_SECONDS, retry: tuple[type[BaseException], ...] = (OSError, TimeoutError), remembered: int = REMEMBERED,
) -> DataFrame:
    """df with the reply to each prompt, `<into>_error` (null if there was none) and `<into>_calls`, in the order of the rows.

    A prompt that is null is not asked. Errors of the kinds in retry are tried again; others, and the last one, leave a null
    reply and their text. Rows that share a prompt share its reply, and only the first of them counts the calls.
    """
    own = [F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns if c not in (into, f"{into}_error", f"{into}_calls")]
    if call is None:
        had = F.col(into).cast("string") if into in df.columns else F.lit(None).cast("string")
        return df.select(*own, had.alias(into), F.lit(None).cast("string").alias(f"{into}_error"), F.lit(0).alias(f"{into}_calls"))
    # As one column, so that names of any kind pass through.
    source = df.select(F.struct(*own).alias("row"), F.col(prompt).cast("string").alias("prompt"))
    schema = T.StructType([source.schema["row"], T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), T.StructField("calls", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(call, tries, wait, retry, remembered)
        with ThreadPoolExecutor(concurrency) as pool:
            for whole in batches:
                for start in range(0, len(whole), window):
                    batch = whole.slice(start, window)
                    text, error, calls = zip(*caller.replies(batch.column("prompt").to_pylist(), pool), strict=True)
                    yield pa.record_batch([batch.column("row"), pa.array(text, pa.string()), pa.array(error, pa.string()), pa.array(calls, pa.int32())], names=["row", "reply", "error", "calls"])

    return source.mapInArrow(run, schema).select("row.*", F.col("reply").alias(into), F.col("error").alias(f"{into}_error"), F.col("calls").alias(f"{into}_calls"))
