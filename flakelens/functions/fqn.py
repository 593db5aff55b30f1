"""Fully qualified test names and the paths derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import join_path, last_segment


def parts(fqn: Column) -> Column:
    return F.split(fqn, r"\.")


def method_name(fqn: Column) -> Column:
    return last_segment(fqn, ".")


def short_class(fqn: Column) -> Column:
    """Last but one part; null for a name without a class."""
    return F.try_element_at(parts(fqn), F.lit(-2))


def _class_parts(fqn: Column) -> Column:
    return F.slice(parts(fqn), F.lit(1), F.greatest(F.size(parts(fqn)) - 1, F.lit(0)))


def class_path(fqn: Column) -> Column:
    return F.array_join(_class_parts(fqn), "/")


def class_fqn(fqn: Column) -> Column:
    return F.array_join(_class_parts(fqn), ".")


def class_file(fqn: Column) -> Column:
    return F.concat(short_class(fqn), F.lit(rules.SOURCE_SUFFIX))


def repo_name(url: Column) -> Column:
    return last_segment(url, "/")


def repo_path(clone_dir: Column, sha: Column, repo: Column) -> Column:
    return join_path(clone_dir, sha, repo)


def result_path(out_dir: Column, repo: Column, sha: Column, fqn: Column) -> Column:
    return join_path(out_dir, repo, sha, F.concat(fqn, F.lit(".json")))


def build_path(test_path: Column, marker: str = rules.SOURCE_ROOT,
               build_file: str = rules.BUILD_FILE) -> Column:
    """Build file of the module that holds a test; null without a source root."""
    return F.when(
        F.contains(test_path, F.lit(marker)),
        F.concat(F.substring_index(test_path, marker, 1), F.lit("/" + build_file)),
    )


def test_id(*natural_keys: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *natural_keys), 256)


def run_id(started: Column) -> Column:
    """SHA-1 of the start time in whole seconds."""
    return F.sha1(F.date_format(started, "yyyy-MM-dd HH:mm:ss"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros / F.lit(1e6), 2)


def elapsed_text(seconds: Column) -> Column:
    """The form used in result documents, for example ``7.01s``."""
    return F.when(seconds.isNotNull(), F.format_string("%.2fs", F.bround(seconds, 2)))
