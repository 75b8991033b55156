"""A data source that carries out planned file actions: a transactional writer.

Tasks carry out the actions and write a journal of what they did, a line for each action; the driver only learns the
journals' names. A copy is made beside its target under a name of its own and then linked there, which never replaces a
file and is never seen half done. If the job commits, the journals become the status rows; if it aborts, what its tasks
have copied is taken away again and what they have moved is moved back.
"""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STATUS = "action string, src string, dst string, status string"
DONE, EXISTS = "done", "exists"


def put(src: str, dst: str, content: bytes | None = None) -> None:
    """The bytes of src (or the content) at dst, which must not exist; dst appears whole or not at all."""
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    beside = os.path.join(os.path.dirname(dst), f".curata-{uuid.uuid4().hex}")
    try:
        if content is None:
            shutil.copy2(src, beside)
        else:
            with open(beside, "wb") as f:
                f.write(content)
        os.link(beside, dst)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def move(src: str, dst: str) -> None:
    """dst, which must not exist, becomes src; at every moment one of them is whole."""
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    try:
        os.link(src, dst)
    except FileExistsError:
        raise
    except OSError:  # another file system
        put(src, dst)
    os.remove(src)


def same(a: str, b: str) -> bool:
    return os.path.isfile(a) and os.path.isfile(b) and filecmp.cmp(a, b, shallow=False)


def carry_out(action: str, src: str, dst: str | None) -> str:
    """The status of one action.

    Done again after a lost task, it finds its own work. A delete that names a copy is done only where that copy is
    another file that holds the same bytes.
    """
    try:
        if action == "delete":
            if dst is not None and not (os.path.isfile(dst) and not os.path.samefile(src, dst) and same(src, dst)):
                return "kept: no finished copy"
            os.remove(src)
        elif action == "copy":
            put(src, dst)
        else:
            move(src, dst)
    except FileExistsError:
        return EXISTS
    except OSError as e:
        return f"failed: {e}"
    return DONE


def undo(action: str, src: str, dst: str | None) -> None:
    """Takes a copy or a move back, where that loses nothing."""
    if action == "copy" and same(src, dst):
        os.remove(dst)
    elif action in ("move", "mark") and os.path.isfile(dst) and not os.path.exists(src):
        move(dst, src)


@dataclass
class Journal(WriterCommitMessage):
    name: str
    done: int


class ActionWriter(DataSourceWriter):
    """Journals of tasks are `name.open` until the job commits."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Journal:
        os.makedirs(self.folder, exist_ok=True)
        name, done = os.path.join(self.folder, f"{uuid.uuid4().hex}.json"), 0
        try:
            with open(f"{name}.open", "w", encoding="utf-8") as out:
                for r in iterator:
                    status = carry_out(r.action, r.src, r.dst)
                    out.write(json.dumps({"action": r.action, "src": r.src, "dst": r.dst, "status": status}) + "\n")
                    out.flush()  # a line says what is done at any moment
                    done += status == DONE
        except BaseException:
            self._undo(name)
            raise
        return Journal(name, done)

    def commit(self, messages: list[Journal | None]) -> None:
        for m in messages:
            if m is not None:
                os.replace(f"{m.name}.open", m.name)
        self._left(undoing=False)

    def abort(self, messages: list[Journal | None]) -> None:
        self._left(undoing=True)

    def _left(self, undoing: bool) -> None:
        """Open journals are of attempts that were lost: of an aborted job all of them, of a committed one those done again."""
        for name in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            if name.endswith(".open"):
                path = os.path.join(self.folder, name)
                self._undo(path.removesuffix(".open")) if undoing else os.remove(path)

    def _undo(self, name: str) -> None:
        with open(f"{name}.open", encoding="utf-8") as f:
            for line in f:
                if line.endswith("\n"):
                    r = json.loads(line)
                    if r["status"] == DONE:
                        undo(r["action"], r["src"], r["dst"])
        os.remove(f"{name}.open")


class ActionSink(DataSource):
    """Carries out rows (action, src, dst); the path option is the folder of the journals, on a store that all have mounted."""

    @classmethod
    def name(cls) -> str:
        return "curata_actions"

    def writer(self, schema, overwrite: bool) -> ActionWriter:
        return ActionWriter(self.options["path"])
