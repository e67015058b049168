"""The domain's rules in plain Python over dictionaries, for comparison on random input."""

import re
from collections import Counter

LETTERS = "WUBRG"


def colour(boards, lands, spells):
    held = lambda kind, x: any(x in kind.get(card, "") and n > 0 for b in boards for card, n in b.items())
    return "".join(x for x in LETTERS if held(lands, x) and held(spells, x)) or "C"


def satisfied(kind, cards, main, side):
    where = {"Mainboard": [main], "Sideboard": [side], "MainOrSideboard": [main, side], "": [main, side]}
    how, place = re.fullmatch("(In|OneOrMoreIn|TwoOrMoreIn|DoesNotContain)(Mainboard|Sideboard|MainOrSideboard|)", kind).groups()
    found = [sum(c in b for b in where[place]) for c in cards]
    return {"In": found[0] > 0, "OneOrMoreIn": sum(found) > 0, "TwoOrMoreIn": sum(found) > 1, "DoesNotContain": found[0] == 0}[how]


def labelled(main, side, rules, color_names):
    """(archetype, color, is_fallback, candidates)"""
    color = colour((main, side), rules.lands, rules.spells)
    name = lambda r: " ".join(([color_names[color]] if r.include_color else []) + re.sub("([a-z])([A-Z])", r"\1 \2", r.name.replace("Generic", "")).split())
    test = lambda r: all(satisfied(k, c, main, side) for k, c in r.conditions)
    hits = []
    for r in filter(test, rules.rules):
        special = [(len(r.conditions) + len(v.conditions), name(v)) for v in r.variants if test(v)]
        hits += special or [(len(r.conditions), name(r))]
    hits.sort(key=lambda h: h[0])
    if hits:
        return hits[0][1], color, False, [h[1] for h in hits]
    copies = lambda r: sum(n for b in (main, side) for c, n in b.items() if c in r.common)
    best = max(rules.fallbacks, key=lambda r: (copies(r), -len(r.common)), default=None)
    if best and copies(best) and copies(best) / max(1, len(main) + len(side)) > 0.1:
        return name(best), color, True, []
    return "Unknown", color, False, []


def tournaments(files, rules, color_names, fmt):
    """(events, lists by id, card rows, match sides) of documents by path."""
    events, lists, cards, sides, seen = [], {}, [], [], set()
    for path in sorted(files, key=lambda p: p.split("/")):
        doc = files[path]
        head = doc["Tournament"]
        if (head.get("Formats") or "").lower() != fmt.lower() or (head.get("Uri") or path) in seen:
            continue
        seen.add(head.get("Uri") or path)
        e, mine = len(events), {}
        events.append((e, path.split("/Tournaments/")[1].split("/")[0], len(doc["Standings"] or doc["Decks"])))
        for deck in doc["Decks"]:
            main, side = ({c["CardName"]: c["Count"] for c in deck[b]} for b in ("Mainboard", "Sideboard"))
            if main:
                d = len(lists)
                lists[d] = (e, deck["Player"], labelled(main, side, rules, color_names))
                mine[deck["Player"]] = d
                cards += [(d, c, b, n) for b, board in (("main", main), ("side", side)) for c, n in board.items()]
        for r in doc["Rounds"]:
            for m in r["Matches"]:
                a, b, games = m["Player1"], m["Player2"], re.fullmatch(r"(\d+)-(\d+)-(\d+)", m["Result"] or "")
                if not games or {a, b} & {"-", "", "BYE", "Bye", "bye"} or games[0] == "0-0-0":
                    continue
                won, lost, drawn = map(int, games.groups())
                for me, opp, x, y in ((a, b, won, lost), (b, a, lost, won)):
                    label = lambda p: lists[mine[p]][2][0] if p in mine else "Unknown"  # noqa: B023, E731
                    sides.append((e, r["RoundName"], me, opp, mine.get(me), mine.get(opp), x, y, drawn, 1.0 if x > y else 0.0 if x < y else 0.5, label(me), label(opp)))
    return events, lists, cards, sides


def record(sides, *keys):
    """{key values: [wins, matches]} of (key dict, score) pairs."""
    wins, n = Counter(), Counter()
    for row, score in sides:
        k = tuple(row[x] for x in keys)
        wins[k] += score
        n[k] += 1
    return {k: (wins[k], n[k]) for k in n}
