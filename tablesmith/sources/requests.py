"""Requests that are paid for once: answers go to a ledger as they come, and what it holds is not asked again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .books import located

AGENT = "tablesmith/1.0"
ENTRY = "request string, body string, error string"


def request_id(url: str, payload: Column) -> Column:
    """The hash that a request is known by: its address and its payload."""
    return F.sha2(F.concat(F.lit(url), F.lit("\n"), payload), 256)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(request, body, error) of every answer so far; a folder that is not there is empty."""
    from pyarrow import fs

    system, at = located(folder)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)


def answered(requests: DataFrame, folder: str, url: str, key: str, timeout: int = 600, parallel: int = 8, repeat_unknown: bool = False) -> DataFrame:
    """(…, request, body, error): each row with the answer to its payload, posted if the ledger ``folder`` has none.

    Equal payloads are one request. Before a request goes out a claim is written, after it the answer, each a small file
    named by the request's hash: a task that runs again, or another run, finds what an earlier attempt has got. A claim without an
    answer says that an attempt ended between the two; such a request may have been served, so it is not sent again
    but has the error ``unknown outcome``, unless ``repeat_unknown``. Refused requests (an HTTP error, no connection)
    are kept with their error and asked again by the next call. At most ``parallel`` tasks send at a time; speculative
    execution has to be off. A null payload is an error and is not sent. Clashing columns are replaced.
    """
    spark = requests.sparkSession
    if (spark.conf.get("spark.speculation", "false") or "false").lower() == "true":
        raise ValueError("with spark.speculation two attempts would send the same request")
    base = requests.drop("request", "body", "error").withColumn("request", request_id(url, F.col("payload")))
    done = ledger(spark, folder).where("body is not null").select("request")
    asked = base.where("payload is not null").select("request", "payload").groupBy("request").agg(F.min("payload").alias("payload"))
    new = asked.join(done, "request", "left_anti").repartition(parallel, "request")
    new.mapInPandas(_sender(folder, f"{url.rstrip('/')}/images/generations", key, timeout, repeat_unknown), "sent int").agg(F.sum("sent")).collect()
    found = ledger(spark, folder)
    missing = F.when(F.col("payload").isNull(), "no payload").otherwise(F.col("error"))
    return base.join(found, "request", "left").withColumn("error", missing).select(*base.columns, "body", "error")


def _sender(folder: str, url: str, key: str, timeout: int, repeat_unknown: bool):
    def send(payload: str) -> tuple[str | None, str | None]:
        from http.client import HTTPException
        from urllib import error, request

        call = request.Request(url, payload.encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json; charset=utf-8", "User-Agent": AGENT}, method="POST")
        try:
            with request.urlopen(call, timeout=timeout) as answer:
                return answer.read().decode(), None
        except error.HTTPError as failed:
            return None, f"HTTP {failed.code}: {failed.read().decode(errors='replace')}"
        except (OSError, HTTPException) as failed:
            return None, f"request failed: {getattr(failed, 'reason', failed)}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, at = located(folder)

        def put(path: str, text: str) -> None:
            system.create_dir(path.rpartition("/")[0], recursive=True)
            beside = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as out:
                out.write(text.encode())
            system.move(beside, path)

        def entry(path: str) -> dict | None:
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return None
            with system.open_input_stream(path) as held:
                return json.loads(held.read())

        for batch in batches:
            sent = 0
            for name, payload in zip(batch["request"], batch["payload"], strict=True):
                place = f"{at}/{name[:2]}/{name}"
                known = entry(f"{place}.json")
                if known and known.get("body") is not None:
                    continue  # an earlier attempt of this task has it
                claimed = system.get_file_info(f"{place}.claim").type != fs.FileType.NotFound
                if claimed and not repeat_unknown and not (known and known.get("error") and not known.get("unknown")):
                    put(f"{place}.json", json.dumps({"request": name, "body": None, "error": "unknown outcome", "unknown": True}))
                    continue
                put(f"{place}.claim", payload)
                if known:
                    system.delete_file(f"{place}.json")  # from here on the claim alone stands
                body, error = send(payload)
                sent += 1
                put(f"{place}.json", json.dumps({"request": name, "body": body, "error": error}))
            yield pd.DataFrame({"sent": [sent]})

    return work
