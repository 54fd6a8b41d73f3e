"""File sources and sinks.

Binary documents are read with the ``binaryFile`` source (one row per file, splittable across
the cluster); DOCX text is unpacked inside tasks with the standard library (a DOCX is a zip of
XML parts), one Arrow batch of files at a time.  Sinks write part files in parallel; nothing is
collected to the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = (".pdf", ".docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def supported_filter(col):
    low = F.lower(col)
    return low.endswith(".pdf") | low.endswith(".docx")


def file_manifest(spark: SparkSession, path: str, recursive: bool = True, prefix: str | None = None,
                  extensions: tuple | None = SUPPORTED) -> DataFrame:
    """List the corpus files under `path` with supported extensions (case-insensitive; None = any)
    and, optionally, a file-name prefix (a dataset id): id, name, size, modification time.  The
    file contents are not read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
          .select("path", "length", "modificationTime"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    if prefix is not None:
        df = df.where(name.startswith(prefix))
    if extensions is not None:
        low = F.lower(name)
        keep = None
        for ext in extensions:
            keep = low.endswith(ext) if keep is None else (keep | low.endswith(ext))
        df = df.where(keep)
    return (df
            .select(F.sha2(F.col("path"), 256).alias("id"), name.alias("filename"), F.col("path").alias("file_path"),
                    F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at")))


def file_manifest_table(files: DataFrame) -> DataFrame:
    """Table form over an upload table (filename, size_bytes, uploaded_at)."""
    return files.where(supported_filter(F.col("filename")))


def _paragraph_text(p) -> str:
    """Texts of the runs in order, tabs as tab characters, breaks as newlines."""
    parts = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{_W}t" else parts.get(x.tag, "")
                   for r in p.iter(f"{_W}r") for x in r)


def docx_text(data: bytes, tables: bool = True) -> str:
    """Paragraph texts joined by newlines, then (unless ``tables`` is false) table rows (cells +
    space, newline per row), stripped.  Paragraphs of the body only (not those inside tables), as
    the reference's document model."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    out = []
    if body is None:
        return ""
    for p in body.findall(f"{_W}p"):
        out.append(_paragraph_text(p) + "\n")
    for tbl in body.findall(f"{_W}tbl") if tables else ():
        for tr in tbl.findall(f"{_W}tr"):
            for tc in tr.findall(f"{_W}tc"):
                cell = "\n".join(_paragraph_text(p) for p in tc.findall(f"{_W}p"))
                out.append(cell + " ")
            out.append("\n")
    return "".join(out).strip()


def _extract_batches(batches):
    for pdf in batches:
        texts, errors = [], []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                if re.search(r"\.docx$", path, re.I):
                    texts.append(docx_text(bytes(content)))
                    errors.append(None)
                else:
                    texts.append(None)
                    errors.append("unsupported file type")
            except Exception as e:  # noqa: BLE001 - kept per file, row not dropped
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pd.DataFrame({"path": pdf["path"], "extracted_text": texts, "error": errors})


def extract_docx(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> (path, extracted_text, error); a file that fails keeps its
    row with a null text and the error."""
    return files.select("path", "content").mapInPandas(_extract_batches,
                                                       "path string, extracted_text string, error string")


# Characters XML 1.0 cannot carry; '\r' is dropped too (XML parsers normalise it away).
_XML_BAD = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f\ufffe\uffff]")


def build_docx(text: str) -> bytes:
    """A minimal DOCX whose body has one paragraph per line of `text` (characters XML cannot carry
    are dropped)."""
    from xml.sax.saxutils import escape
    paras = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_XML_BAD.sub("", line))}</w:t></w:r></w:p>'
                    for line in text.split("\n"))
    xml = ('<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/'
           f'wordprocessingml/2006/main"><w:body>{paras}</w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types/>')
        z.writestr("word/document.xml", xml.encode("utf-8"))
    return buf.getvalue()


def _docx_batches(batches):
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "content": [build_docx(t or "") for t in pdf["text"]]})


def render_docx(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, text) -> (path, content) DOCX bytes, built inside tasks — the same shape as a
    ``binaryFile`` read, so it feeds :func:`extract_docx` directly."""
    return df.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")) \
        .mapInPandas(_docx_batches, "path string, content binary")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line (non-ASCII kept), written as parallel part files."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_features(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Persist features as json, csv or parquet; nested columns are JSON-encoded for CSV."""
    if fmt == "csv":
        flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                           if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
                           for f in df.schema.fields])
        flat.write.mode(mode).option("header", "true").csv(path)
    elif fmt in ("json", "parquet"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unsupported output format: {fmt}")
