"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from hotzone.llm import align  # noqa: F401
from hotzone.llm import chat_format  # noqa: F401
from hotzone.llm import decontaminate  # noqa: F401
from hotzone.llm import embedding_dedup  # noqa: F401
from hotzone.llm import hard_negatives  # noqa: F401
from hotzone.llm import html_extract  # noqa: F401
from hotzone.llm import licence_scan  # noqa: F401
from hotzone.llm import line_dedup  # noqa: F401
from hotzone.llm import near_dedup  # noqa: F401
from hotzone.llm import pack  # noqa: F401
from hotzone.llm import pii  # noqa: F401
from hotzone.llm import substring_dedup  # noqa: F401
from hotzone.llm import toxicity  # noqa: F401
from hotzone.llm.common import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
