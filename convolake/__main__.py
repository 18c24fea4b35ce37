"""python -m convolake FOLDER COMMAND [ARGUMENT...]: the doors of a Corpus from the shell; rows come as JSON lines."""

from __future__ import annotations

import argparse
import sys

from convolake.corpus import Corpus
from convolake.session import session

#: command -> (help, what it shows of a corpus and its arguments)
COMMANDS = {
    "search": ("WORD...: ranked hits; file:PATH finds threads by path", lambda c, a, n: c.search(" ".join(a), n)),
    "recent": ("the threads changed last", lambda c, a, n: c.recent(n)),
    "show": ("THREAD: its messages", lambda c, a, n: c.thread(int(a[0]))),
    "context": ("THREAD: its packed transcript after its project's memory", lambda c, a, n: c.payload(int(a[0]))),
    "files": ("PATH: threads that mention it", lambda c, a, n: c.threads_for_file(a[0], n)),
    "tags": ("tags with their threads", lambda c, a, n: c.tags()),
    "todos": ("[WORD]: open todos", lambda c, a, n: c.open_todos(a[0] if a else "", limit=n)),
    "knowledge": ("THREAD: what is known of it", lambda c, a, n: c.knowledge(int(a[0]))),
    "decisions": ("PROJECT: its decisions", lambda c, a, n: c.decisions(a[0])),
    "projects": ("projects with their coverage", lambda c, a, n: c.projects()),
    "memory": ("projects' notes", lambda c, a, n: c.project_memory(n)),
    "commits": ("THREAD: commits linked to it", lambda c, a, n: c.linked_commits(int(a[0]))),
    "issues": ("errors that come again", lambda c, a, n: c.recurring_issues(limit=n)),
    "stats": ("totals", lambda c, a, n: c.stats()["totals"]),
    "usage": ("tokens by model", lambda c, a, n: c.usage()),
    "pending": ("threads to be distilled", lambda c, a, n: c.pending(n)),
    "snapshots": ("kept transcripts", lambda c, a, n: c.snapshots()),
}


def main(argv: list[str]) -> int:
    about = "\n".join(f"  {name:10} {text}" for name, (text, _) in COMMANDS.items())
    parser = argparse.ArgumentParser("convolake", description=__doc__, epilog=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("folder")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("argument", nargs="*")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--index", help="a stored full-text index")
    given = parser.parse_args(argv)
    spark = session("local[*]", **{"spark.ui.showConsoleProgress": "false"})
    rows = COMMANDS[given.command][1](Corpus(spark, given.folder, given.index), given.argument, given.limit)
    for line in rows.limit(max(given.limit, 0)).toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
