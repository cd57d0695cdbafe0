"""E-mails: headers, attachments, selection, previews."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formflow.functions import text as T

HEADERS = ("subject", "from", "to", "date", "message_id")
PARTS = "array<struct<part_idx:int,filename:string,content_type:string,size_bytes:bigint,payload:binary>>"
METADATA = "struct<subject:string,`from`:string,`to`:string,`date`:string,message_id:string>"


def parse_messages(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``metadata`` and all MIME leaf ``parts`` of each message.

    Missing headers are ''. A part without payload has size 0 and a null
    payload. Bytes that are no message give '' headers and one empty part;
    null content gives nulls.
    """

    @F.pandas_udf(f"metadata {METADATA}, parts {PARTS}")
    def parse(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in contents:
            if raw is None:
                rows.append((None, None))
                continue
            message = email.message_from_bytes(bytes(raw), policy=email.policy.compat32)
            head = {h: _text(message.get(h.replace("_", "-"), "")) for h in HEADERS}
            parts = []
            for i, part in enumerate(p for p in message.walk() if not p.is_multipart()):
                payload = part.get_payload(decode=True) or None
                name = part.get_filename()
                parts.append(
                    {
                        "part_idx": i, "filename": _text(name) if name else None, "content_type": part.get_content_type(),
                        "size_bytes": len(payload) if payload else 0, "payload": payload,
                    }
                )
            rows.append((head, parts))
        return pd.DataFrame(rows, columns=["metadata", "parts"])

    return files.withColumn("_m", parse(F.col(content))).select("*", "_m.metadata", "_m.parts").drop("_m")


def _text(value) -> str:
    """A header as text; encoded words are decoded, broken ones kept."""
    from email.header import decode_header, make_header

    try:
        return str(make_header(decode_header(str(value))))
    except (LookupError, UnicodeError, ValueError):
        return str(value)


def is_pdf(content_type: Column, filename: Column) -> Column:
    """PDF by type or, in any case, by name; null parts are none."""
    return F.coalesce(content_type == "application/pdf", F.lit(False)) | F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False))


def attachment_rows(messages: DataFrame, key: str = "email_id") -> DataFrame:
    """``(key, stem, part_idx, filename, content_type, size_bytes, payload)``, one row a part."""
    return messages.select(key, T.stem(F.col("path")).alias("stem"), F.explode("parts").alias("p")).select(key, "stem", "p.*")


def list_attachments(parts: DataFrame, by: list[str], order: list[str], stem: Column) -> DataFrame:
    """PDF attachments numbered without gaps, with default names and readable sizes.

    Parts without payload have size 0 and take a number too.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    kept = parts.filter(is_pdf(F.col("content_type"), F.col("filename"))).withColumn("index", F.row_number().over(w) - 1)
    default = F.concat(stem, F.lit("_attachment_"), (F.col("index") + 1).cast("string"), F.lit(".pdf"))
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    return kept.select(
        *by, "index", F.coalesce(F.nullif("filename", F.lit("")), default).alias("filename"), size.alias("size_bytes"),
        T.readable_size(size).alias("size_readable"), *(["payload"] if "payload" in parts.columns else []),
    )


def select_attachments(listed: DataFrame, selected: DataFrame | None, by: list[str]) -> DataFrame:
    """Chosen attachments with a payload; without a choice all of them.

    ``selected`` has ``by`` and ``index``; a semi join, so repeated choices
    don't repeat rows.
    """
    chosen = listed if selected is None else listed.join(selected, [*by, "index"], "left_semi")
    return chosen.filter(F.col("size_bytes") > 0)


def interactive_attachments(parts: DataFrame) -> DataFrame:
    """Parts with a name and a payload that are images or PDFs; images as data URLs."""
    image, pdf = F.col("content_type").startswith("image/"), is_pdf(F.col("content_type"), F.col("filename"))
    named = parts.filter(F.col("filename").isNotNull() & (F.col("filename") != "") & F.col("payload").isNotNull() & (image | pdf))
    return named.select(
        "*", pdf.alias("is_pdf"), F.when(image & ~pdf, T.data_url(F.col("payload"), F.lit("image/png"))).alias("data")
    )


def preview(messages: DataFrame, key: str = "email_id") -> DataFrame:
    """Metadata and attachment list of each message, nothing extracted."""
    parts = attachment_rows(messages, key).drop("payload")
    listed = list_attachments(parts, [key], ["part_idx"], F.max("stem").over(Window.partitionBy(key)))
    grouped = listed.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("index", "filename", "size_bytes", "size_readable"))).alias("attachments")
    )
    return messages.select(key, "metadata").join(grouped, key, "left").withColumn("attachments", F.coalesce("attachments", F.array()))


def normalize_pages(files: DataFrame, rasterizer, key: list[str]) -> DataFrame:
    """Pages of PDF payloads: ``(key…, page_idx, image binary)``.

    ``rasterizer(bytes) -> list[bytes]`` is supplied (none is bundled); a file
    it fails on gives no page, as the rest of the batch must go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False):
                *ids, payload = values
                try:
                    pages = rasterizer(bytes(payload)) if payload is not None else []
                except Exception:
                    pages = []
                rows += [(*ids, i, p) for i, p in enumerate(pages)]
            yield pd.DataFrame(rows, columns=[*key, "page_idx", "image"])

    fields = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)
    return files.select(*key, "payload").mapInPandas(run, f"{fields}, page_idx int, image binary")
