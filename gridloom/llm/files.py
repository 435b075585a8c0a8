"""Byte files in the shared folder, written and read inside tasks.

A file system is found from the folder's URI, so a local mount, HDFS and object stores all work.  A task
names its file afresh on every attempt; only the index rows of the attempt that Spark commits refer to it,
so a lost executor or a speculative copy leaves at most an unread file behind.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def fresh_name(root: str, suffix: str) -> str:
    return f"{root}/{uuid.uuid4().hex}{suffix}"
