"""Row-by-row replay in plain Python: a third opinion for the window operators."""

from collections import defaultdict


def ordered(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["date"], r["seq"]))


def streak(history):
    if not history:
        return 0
    last, n = history[-1][1], 0
    for _, won, _ in reversed(history):
        if won != last:
            break
        n += 1
    return n if last else -n


def form(df, windows=(5, 10)):
    hist, out = defaultdict(list), {}
    for r in ordered(df):
        for side, other in (("a", "b"), ("b", "a")):
            h = hist[r["gender"], r[f"team_{side}"]]
            row = {"matches_played": len(h), "current_streak": streak(h),
                   "days_since_last": (r["date"] - h[-1][0]).days if h else None}
            for n in windows:
                tail = h[-n:]
                row[f"win_rate_last{n}"] = sum(x[1] for x in tail) / len(tail) if tail else None
                row[f"set_margin_avg_last{n}"] = sum(x[2] for x in tail) / len(tail) if tail else None
            out[r["seq"], side] = row
        for side, other in (("a", "b"), ("b", "a")):
            hist[r["gender"], r[f"team_{side}"]].append(
                (r["date"], r["winner"] == f"team_{side}", r[f"sets_{side}"] - r[f"sets_{other}"]))
    return out


def h2h(df):
    met, out = defaultdict(list), {}
    for r in ordered(df):
        key = (r["gender"], *sorted((r["team_a"], r["team_b"])))
        prior = met[key]
        out[r["seq"]] = (len(prior), sum(w == r["team_a"] for w in prior) / len(prior) if prior else None)
        prior.append(r[r["winner"]])
    return out


def elo(df, k=32.0, initial=1500.0, scale=400.0):
    ratings, out = {}, {}
    for r in ordered(df):
        a, b = (r["gender"], r["team_a"]), (r["gender"], r["team_b"])
        ra, rb = ratings.get(a, initial), ratings.get(b, initial)
        e = 1 / (1 + 10 ** ((rb - ra) / scale))
        y = 1.0 if r["winner"] == "team_a" else 0.0
        ratings[a], ratings[b] = ra + k * (y - e), rb + k * (e - y)
        out[r["seq"]] = (ra, rb, e, ratings[a], ratings[b])
    return out, ratings
