"""Plugins that are programs of their own: each task keeps one running and streams its files through it.

A program reads one JSON object a line, {"path": ..., "content": ...}, and answers each with one line: the JSON of a plugin's
`decoder_format`. A program that dies, answers with something else, or takes longer than `seconds` gives that file no rows; it is
started anew for the next one, and the task goes on.
"""

from __future__ import annotations

import json
import os
import select
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ELEMENTS = "repository_id string, file_path string, name string, element_type string, line_number int, language string"
SECONDS = 30.0


class Program:
    """A running plugin."""

    def __init__(self, command: list[str], seconds: float):
        self.command, self.seconds, self.process, self.rest = command, seconds, None, b""

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            for stream in (self.process.stdin, self.process.stdout):
                stream.close()
            self.process, self.rest = None, b""

    def ask(self, question: dict) -> dict | None:
        """The answer, or None where there is none; then the program isn't trusted any more."""
        try:
            if self.process is None or self.process.poll() is not None:
                self.close()
                self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
                os.set_blocking(self.process.stdin.fileno(), False)
            answer = json.loads(self._exchange(json.dumps(question).encode() + b"\n"))
            if not isinstance(answer, dict):
                raise ValueError("no object")
            return answer
        except (OSError, ValueError, TimeoutError):
            self.close()
            return None

    def _exchange(self, sent: bytes) -> bytes:
        """Writes a line and reads one, whatever the program does first."""
        out, into, until, view = self.process.stdout.fileno(), self.process.stdin.fileno(), time.monotonic() + self.seconds, memoryview(sent)
        while b"\n" not in self.rest:
            left = until - time.monotonic()
            if left <= 0:
                raise TimeoutError
            ready, writable, _ = select.select([out], [into] if view else [], [], left)
            if writable:
                view = view[os.write(into, view[: 1 << 16]) :]
            if ready:
                got = os.read(out, 1 << 16)
                if not got:
                    raise OSError("the program ended")
                self.rest += got
        line, _, self.rest = self.rest.partition(b"\n")
        return line


def program_elements(files: DataFrame, command: list[str], seconds: float = SECONDS) -> DataFrame:
    """Code elements that the program finds in files (repository_id, path, content)."""
    columns = [c.split()[0] for c in ELEMENTS.split(", ")]

    def rows_of(repository: str, path: str, answer: dict | None) -> Iterator[tuple]:
        form = (answer or {}).get("decoder_format")
        for e in (form.get("code_elements") if isinstance(form, dict) else None) or ():
            if isinstance(e, dict) and isinstance(e.get("name"), str):
                line = e.get("line_number")
                yield repository, e.get("file_path") or path, e["name"], e.get("element_type"), line if isinstance(line, int) else None, e.get("language")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = Program(command, seconds)
        try:
            for f in batches:
                rows = [r for repository, path, content in f.itertuples(index=False) for r in rows_of(repository, path, program.ask({"path": path, "content": content}))]
                out = pd.DataFrame(rows, columns=columns)
                out["line_number"] = out["line_number"].astype("Int32")
                yield out.astype({c: object for c in columns if c != "line_number"})
        finally:
            program.close()

    return files.select("repository_id", "path", "content").mapInPandas(asked, ELEMENTS)
