"""Extraction of HTTP payloads: a plan with a name for every payload, reports, and the files themselves."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import sha1
from ..functions.http import content_type_matches, http_content_type, http_header, is_response_record, with_payload
from ..functions.text import escapes_folder, hashed_name, output_name, url_host
from ..sources.files import locate


def responses(records: DataFrame, content_types: list[str] | None = None) -> DataFrame:
    """HTTP response records whose HTTP Content-Type contains one of the given strings (all, if none is given)."""
    own = records.where(F.col("error").isNull() & is_response_record("warc_type", "content_type"))
    return own.withColumn("http_content_type", http_content_type("content")).where(content_type_matches("http_content_type", content_types))


def extract_report(selected: DataFrame) -> DataFrame:
    """(file, http_content_type, count) of `responses`."""
    return selected.groupBy("file", "http_content_type").agg(F.count(F.lit(1)).alias("count"))


def extract_plan(selected: DataFrame, host_sort: bool = False) -> DataFrame:
    """Adds `folder`, `name`, `refused`, `payload` and `payload_sha1` to `responses`.

    `folder` is the host with its port under `host_sort`, else empty. Names that lead out of the folder are refused.
    """
    named = with_payload(selected, "content", "payload", decode=True).withColumns({
        "folder": url_host("target_uri") if host_sort else F.lit(""),
        "name": output_name("target_uri", http_header("content", "Content-Disposition")),
    })
    refused = escapes_folder(F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat("folder", F.lit("/"), "name")))
    return named.withColumns({"refused": refused | F.col("payload").isNull(), "payload_sha1": sha1("payload")})


def final_names(plan: DataFrame, hash_suffix: bool = False, allow_overwrite: bool = False) -> DataFrame:
    """Adds `out_name`: what each payload is called in its folder, null if it is not written.

    Of payloads with one name, in order of file and record, the first has it. Later ones are left out if they are
    the same; else they have a name with their digest under `hash_suffix`, and without it are left out. With
    `allow_overwrite` alone the last one counts. Content should be left out of `plan`: the window shuffles it.
    """
    w = Window.partitionBy("folder", "name")
    order = ("file", "record_index")
    able = plan.withColumn("__ok", ~F.col("refused"))
    if allow_overwrite and not hash_suffix:
        back = w.orderBy(F.desc("__ok"), *(F.desc(c) for c in order))
        return able.withColumn("out_name", F.when(F.col("__ok") & (F.row_number().over(back) == 1), F.col("name"))).drop("__ok")
    forth = w.orderBy(F.desc("__ok"), *order)
    first = F.first("payload_sha1").over(forth)
    twin = Window.partitionBy("folder", "name", "payload_sha1").orderBy(F.desc("__ok"), *order)
    again = F.when(F.lit(hash_suffix) & (F.row_number().over(twin) == 1), hashed_name("name", "payload_sha1"))
    name = F.when(F.row_number().over(forth) == 1, F.col("name")).when(F.col("payload_sha1") != first, again)
    return able.withColumn("out_name", F.when(F.col("__ok"), name)).drop("__ok")


def write_payloads(plan: DataFrame, folder: str, hash_suffix: bool = False, allow_overwrite: bool = False) -> DataFrame:
    """Write payloads under `folder` (path or URI); (file, record_index, out_name, status) for every planned row.

    Names are settled by final_names on digests alone, then joined back to the payloads. A file that is already
    there is left if it holds the same bytes, or unless `allow_overwrite`; under `hash_suffix` a different one is
    written beside it. Written files replace old ones whole. Status: written, exists, left_out or refused. Files
    are written when the result is computed; a task that runs again finds its own file and leaves it.
    """
    keys = ("file", "record_index")
    names = final_names(plan.select(*keys, "folder", "name", "refused", "payload_sha1"), hash_suffix, allow_overwrite)
    renamed = names.select(*(F.col(k).alias(f"__{k}") for k in keys), "out_name")
    rows = plan.join(renamed, (plan.file == F.col("__file")) & (plan.record_index == F.col("__record_index"))).select(
        *keys, "folder", "name", "out_name", "refused", F.when(F.col("out_name").isNotNull(), F.col("payload")).alias("payload"))

    def same(system: fs.FileSystem, path: str, data: bytes) -> bool:
        with system.open_input_stream(path, compression=None) as f:
            return f.read() == data

    def put(system: fs.FileSystem, base: str, sub: str, name: str, out: str, data: bytes) -> tuple[str, str]:
        home = f"{base}/{sub}" if sub else base
        path = f"{home}/{out}"
        if system.get_file_info(path).type == fs.FileType.File:
            if same(system, path, data):
                return out, "exists"
            if hash_suffix and out == name:
                digest = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
                stem, dot, tail = out.rpartition(".")
                out = f"{(stem if dot else out)[:230]}[{digest[26:]}]{dot + tail if dot else ''}"
                path = f"{home}/{out}"
                if system.get_file_info(path).type == fs.FileType.File and not allow_overwrite:
                    return out, "exists"
            elif not allow_overwrite:
                return out, "exists"
        system.create_dir(home, recursive=True)
        with system.open_output_stream(f"{path}.open", compression=None) as f:
            f.write(data)
        system.move(f"{path}.open", path)
        return out, "written"

    def run(it):
        system, base = locate(folder)
        for batch in it:
            cols = batch.to_pydict()
            outs, status = [], []
            for sub, name, out, refused, data in zip(*(cols[c] for c in ("folder", "name", "out_name", "refused", "payload"))):
                if refused or out is None:
                    outs.append(None)
                    status.append("refused" if refused else "left_out")
                else:
                    o, s = put(system, base, sub, name, out, data)
                    outs.append(o)
                    status.append(s)
            yield pa.RecordBatch.from_pydict({
                "file": pa.array(cols["file"], pa.string()), "record_index": pa.array(cols["record_index"], pa.int64()),
                "out_name": pa.array(outs, pa.string()), "status": pa.array(status, pa.string())})

    return rows.mapInArrow(run, "file string, record_index long, out_name string, status string")
