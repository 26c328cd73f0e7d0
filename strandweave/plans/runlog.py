"""Run log kept next to the results of an assembly."""

from __future__ import annotations

import logging
import os
import sys
from contextlib import contextmanager
from datetime import datetime


@contextmanager
def run_log(out_dir: str, echo: bool = True):
    """Logger that appends to ``<out_dir>/log/pipeline.log`` under a dated header.

    An exception is logged with its trace and raised again.
    """
    folder = os.path.join(out_dir, "log")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "pipeline.log")
    log = logging.Logger(f"strandweave:{path}", logging.INFO)
    to_file = logging.FileHandler(path, mode="a")
    log.addHandler(to_file)
    rule = "=" * 72
    log.info("\n%s\nRUN  %s\n%s", rule, datetime.now().strftime("%Y-%m-%d %H:%M:%S"), rule)
    if echo:
        log.addHandler(logging.StreamHandler(sys.stdout))
    try:
        yield log
    except Exception:
        log.exception("ERROR")
        raise
    finally:
        to_file.close()
