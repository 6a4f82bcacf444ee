import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from courtside.session import local_session  # noqa: E402

MATCH_DDL = ("match_id string, seq bigint, date date, gender string, team_a string, team_b string, "
             "sets_a int, sets_b int, winner string")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ladder(spark):
    """60 matches, four teams of falling strength, one upset, sides alternating by round."""
    teams = ["STRONG", "MID", "WEAK", "BOTTOM"]
    rows, day, seq = [], date(2015, 1, 1), 0
    for rnd in range(10):
        for i in range(4):
            for j in range(i + 1, 4):
                strong, weak = teams[i], teams[j]
                a, b = (strong, weak) if rnd % 2 == 0 else (weak, strong)
                upset = rnd == 7 and (strong, weak) == ("STRONG", "BOTTOM")
                a_won = (a == strong) != upset
                lost = seq % 3
                rows.append((f"m{seq}", seq, day, "men", a, b, 3 if a_won else lost, lost if a_won else 3,
                             "team_a" if a_won else "team_b"))
                day += timedelta(days=1)
                seq += 1
    return spark.createDataFrame(rows, MATCH_DDL)


@pytest.fixture(scope="session")
def crowded(spark):
    """700 matches with one team in over a third of them, many same-day ties and one very full day."""
    import random
    rng = random.Random(5)
    teams = [f"T{i}" for i in range(7)]
    rows = []
    for seq in range(700):
        a = "T0" if rng.random() < 0.4 else rng.choice(teams)
        b = rng.choice([t for t in teams if t != a])
        if rng.random() < 0.5:
            a, b = b, a
        day = date(2020, 1, 1) + timedelta(days=40 if rng.random() < 0.3 else rng.randrange(90))
        a_won, lost = rng.random() < 0.6, rng.randrange(3)
        rows.append((f"m{seq}", seq, day, "men" if rng.random() < 0.8 else "women", a, b,
                     3 if a_won else lost, lost if a_won else 3, "team_a" if a_won else "team_b"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, MATCH_DDL)
