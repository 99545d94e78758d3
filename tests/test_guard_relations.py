import random

import pytest
from pyspark.sql import functions as F

from quillguard.functions import shell
from quillguard.operators import guard
from quillguard.plans import fixtures

WORDS = ["rm", "-rf", "-fr", "-r", "--recursive", "--force", "--", "/", "/etc/", "/etc/*", "./x", "~", "sudo", "A=1", "find", "-delete", "-exec", "shred", "/bin/rm", "chown", "-R", "bob", "/var", "init", "0", "6", "3", "systemctl", "stop", "halt", "docker", "prune", "git", "push", "-f", "--force-with-lease", "curl", "|", "bash", "/usr/bin/sh", ";", "&&", "mkfs.ext4", "/dev/sda", "mkswap", "wipefs", "dd", "of=/dev/sda", ">", "kubectl", "delete", "--all", "-A", "'a b'", "\"/\"", "history", "-c", "parted", "-s", "--script=1", "DROP", "TABLE", "DELETE", "FROM", "t", "WHERE", "x;", "update", "set", "terraform", "destroy", "-auto-approve", "ufw", "reset", "/etc/shadow", ":(){ :|:& };:", "\n", "\n", "the", "and", "$"]


def cases(seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, n)))
    out = []
    for _ in range(120):
        body = line(12)
        out.append(rng.choice(["```sh\n%s\n```\nafter", "before\n~~~\n%s\n~~~", "$ %s", "see `%s` now", "%s", "```\n%s"]) % body + rng.choice(["", "\n" + line(6), "\n`rm -rf /` and `rm -rf /`"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_predicates_agree_with_the_reader_of_streams(spark, seed):
    texts = [*cases(seed), *[t for t, _ in fixtures.GUARDED], *[t for t, _ in fixtures.WITHHELD], "", None, "x" * 50 + "\nrm -rf / " + "y" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4)
    changed = {"rm_recursive_force": "block", "sql_drop": "warn"}
    found = guard.withheld(guard.inspect(guard.inspect(rows).withColumnRenamed("guard_findings", "f").drop("verdict"), overrides=changed), out="w")
    got = {r.i: r for r in found.select("i", "f", F.col("guard_findings").alias("g"), "w").collect()}
    plain = lambda found: [tuple(f[k] for k in ("rule", "severity", "match", "scope", "line", "end_line")) for f in found]
    for i, text in enumerate(texts):
        want = [f for f in shell.inspect(text or "") if "repeat" not in f]
        assert plain(got[i].f) == plain(want), text
        assert plain(got[i].g) == plain([f for f in shell.inspect(text or "", changed) if "repeat" not in f]), text
        assert got[i].w == (shell.withhold(text) if text else text), text
    assert {f["rule"] for r in got.values() for f in r.f} == {r.name for r in shell.RULES}
