"""A small, well-formed pitch-by-pitch table for end-to-end tests."""
import datetime as dt
import random

EVENTS_OUT = ["field_out", "strikeout", "force_out"]
EVENTS_ON = ["single", "double", "walk", "hit_by_pitch", "home_run"]
BB = ["ground_ball", "line_drive", "fly_ball", "popup", None]

SCHEMA = ("game_pk long, game_date date, game_year int, at_bat_number int, pitch_number int, "
          "inning int, inning_topbot string, pitcher long, batter long, on_1b long, on_2b long, "
          "on_3b long, outs_when_up int, bat_score int, fld_score int, post_bat_score int, "
          "post_fld_score int, home_score int, away_score int, post_home_score int, "
          "post_away_score int, bat_score_diff int, events string, description string, "
          "des string, bb_type string, plate_x double, plate_z double, sz_top double, "
          "sz_bot double, launch_speed double, launch_angle double, hit_distance_sc double, "
          "launch_speed_angle int, woba_value double, woba_denom double")


def make_pitches(n_games=8, seed=3):
    rnd = random.Random(seed)
    rows = []
    for g in range(n_games):
        year = 2023 + g % 2
        date = dt.date(year, 5, 1) + dt.timedelta(days=g // 2 + (g % 3))
        score = {"home": 0, "away": 0}
        ab = 0
        for inning in range(1, 10):
            for half in ("Top", "Bot"):
                bat, fld = ("away", "home") if half == "Top" else ("home", "away")
                starter = 100 if half == "Top" else 200
                pitcher = starter if inning <= 6 else starter + 1 + (inning - 7)
                outs, bases = 0, [None, None, None]
                while outs < 3:
                    ab += 1
                    batter = 1000 + rnd.randint(0, 11) + (0 if bat == "home" else 50)
                    n_p = rnd.randint(1, 3)
                    out = rnd.random() < 0.68
                    ev = rnd.choice(EVENTS_OUT if out else EVENTS_ON)
                    runs = 0 if out else sum(b is not None for b in bases) * (ev == "home_run") + (
                        1 if ev == "home_run" else (1 if bases[2] is not None and ev != "walk" else 0))
                    for p in range(1, n_p + 1):
                        last = p == n_p
                        hs, as_ = score["home"], score["away"]
                        post = dict(score)
                        if last:
                            post[bat] += runs
                        bb = rnd.choice(BB) if last and ev not in ("walk", "strikeout", "hit_by_pitch") else None
                        ls = rnd.uniform(60, 115) if bb else None
                        rows.append((
                            g + 1, date, year, ab, p, inning, half, pitcher, batter,
                            bases[0], bases[1], bases[2], outs, score[bat], score[fld],
                            post[bat], post[fld], hs, as_, post["home"], post["away"],
                            score[bat] - score[fld], ev if last else None,
                            "hit_into_play" if bb else "ball", (ev or "") + (" balk" if rnd.random() < 0.01 else ""),
                            bb, rnd.uniform(-1.8, 1.8), rnd.uniform(0.5, 4.5), 3.4, 1.6,
                            ls, rnd.uniform(-30, 50) if bb else None,
                            rnd.uniform(50, 430) if bb else None,
                            rnd.randint(1, 6) if bb else None,
                            (0.9 if ev in EVENTS_ON else 0.0) if last else None,
                            1.0 if last else None))
                    score[bat] += runs
                    if out:
                        outs += 1
                    else:
                        bases = [batter, bases[0], bases[1]] if ev != "home_run" else [None] * 3
    return rows
