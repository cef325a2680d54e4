import random
import textwrap

import pytest

from popspark.llm import licenses


@pytest.mark.parametrize("width", [60, 70, 80])
def test_every_template_wrapped(width):
    prose = "Some words of prose that say nothing of the kind stand here.\n" * 12
    scanner = licenses.Scanner()
    for name, notice in licenses.TEMPLATES:
        got = scanner.scan(prose + textwrap.fill(notice, width) + "\n" + prose)
        assert [(x[2], x[5]) for x in got] == [(name, 0)], name


def test_edited_notice_in_a_long_line():
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(n))
    mpl = dict(licenses.TEMPLATES)["MPL-2.0"].replace("distributed", "shipped")
    for n in (50, 200, 1000):
        text = f"{prose(n)} {mpl} {prose(n)} Licensed under CC BY-SA 4.0. {prose(n)}"
        got = licenses.Scanner().scan(text)
        assert [(x[2], x[5] > 0) for x in got] == [("MPL-2.0", True), ("CC-BY-SA-4.0", False)], n
