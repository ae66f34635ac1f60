"""Documents that arrive in parts: which parts count, and the bodies that they make."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import folded

#: Bytes that a document may have, and minutes after which an upload without a new part is given up.
MOST_BYTES, LIFE = 50 << 20, 30
# Names of uploads, and base64 as the standard writes it.
NAME, BASE64 = r"^[a-zA-Z0-9_\-.]{1,128}$", r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def judged(steps: DataFrame, most: int = MOST_BYTES, life: int = LIFE) -> DataFrame:
    """(upload_id, seq, action, status, session, part, offset, bytes) of rows (upload_id, seq, action, part, data, at).

    Steps of an upload are taken by seq (unique in it). Status: started, buffered or finished, or why a step changed
    nothing: bad_name, in_use (a start of what is open), unknown (no open upload, or its life is over: more than `life`
    minutes since its start or last part), no_part, bad_data (not base64, null included), out_of_order (gaps and repeats),
    bad_action; too_large gives the upload up. A name may be used again once it is finished; session counts its starts.
    """
    valid = F.coalesce(F.regexp_replace("data", r"[\r\n]", "").rlike(BASE64), F.lit(False))
    decoded = F.octet_length(F.when(valid, F.unbase64("data")))
    rows = steps.select("upload_id", "seq", "action", F.col("part").cast("long").alias("part"), F.col("at").cast("timestamp_ntz").alias("at"), F.coalesce(F.col("upload_id").rlike(NAME), F.lit(False)).alias("named"), decoded.cast("long").alias("size"))

    def step(state, row):
        if row is None:
            return None, []
        sessions, is_open, expected, held, last = state or (0, False, 0, 0, None)
        is_open = is_open and not row["at"] - last > dt.timedelta(minutes=life)
        action, status, offset, size = row["action"], None, None, None
        if action == "start":
            status = "bad_name" if not row["named"] else "in_use" if is_open else "started"
            if status == "started":
                sessions, is_open, expected, held, last = sessions + 1, True, 0, 0, row["at"]
        elif action == "append":
            if row["part"] is None or row["part"] < 0:
                status = "no_part"
            elif row["size"] is None:
                status = "bad_data"
            elif not is_open:
                status = "unknown"
            elif row["part"] != expected:
                status = "out_of_order"
            elif held + row["size"] > most:
                status, is_open = "too_large", False
            else:
                status, offset, size = "buffered", held, row["size"]
                expected, held, last = expected + 1, held + row["size"], row["at"]
        elif action == "finish":
            status = "finished" if is_open else "unknown"
            size, is_open = (held, False) if is_open else (None, False)
        else:
            status = "bad_action"
        out = {"seq": row["seq"], "action": action, "status": status, "session": sessions, "part": row["part"], "offset": offset, "bytes": size}
        return (sessions, is_open, expected, held, last), [out]

    return folded(rows, ["upload_id"], ["seq"], step, f"seq {steps.schema['seq'].dataType.simpleString()}, action string, status string, session long, part long, offset long, bytes long")


def bodies(steps: DataFrame, most: int = MOST_BYTES, life: int = LIFE) -> DataFrame:
    """(upload_id, session, parts, bytes, body binary) of finished uploads; a body has at most `most` bytes, so it is one row.

    Parts are decoded one by one, as each may begin or end within a character.
    """
    said = judged(steps, most, life)
    done = said.where("status = 'finished'").select("upload_id", "session", "bytes")
    parts = said.where("status = 'buffered'").select("upload_id", "session", "part", "seq").join(steps.select("upload_id", "seq", F.unbase64("data").alias("raw")), ["upload_id", "seq"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("raw").alias("raw")))), lambda p: p["raw"]), "")
    made = parts.groupBy("upload_id", "session").agg(F.count("*").alias("parts"), F.unhex(joined).alias("body"))
    empty = F.unhex(F.lit(""))
    return done.join(made, ["upload_id", "session"], "left").select("upload_id", "session", F.coalesce("parts", F.lit(0)).alias("parts"), "bytes", F.coalesce("body", empty).alias("body"))
