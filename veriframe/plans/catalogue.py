"""The catalogue of class and type designations: entries as a table, its checking, and look-up by column expressions.

The entries below are shipped, any
other catalogue is a table of the same columns (load). A checked catalogue has a bounded number of entries and becomes
a literal of the plan, so looking texts up joins and shuffles nothing."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as X

ENTRY = ("commodity string, entry int, names array<string>, kind string, sufficient string, min_abv double, "
         "produced_in string, qualifier string, note string, composition string")
COMMODITIES = ("malt", "wine", "spirits")
SUFFICIENT = ("true", "false", "conditional")
#: A catalogue of more entries than this is refused: it would not be a literal of bounded size.
MOST_ENTRIES = 20_000

# Designations in the order in which they are looked up, as plain lists of names. Whiskey is read as whisky.
_ELSEWHERE = "type, American or a statement of the true place of production"
MALT = [
    {"names": ["ale", "beer", "lager", "lager beer", "malt liquor", "porter", "stout"]},
    {"names": ["cereal beverage", "near beer"]},
    {"names": ["amber ale", "amber lager", "barley wine ale", "barley wine style ale", "bitter ale", "bock beer", "brown ale", "cream ale", "cream stout", "dry beer", "export ale", "export beer",
               "golden ale", "golden lager", "ice beer", "imperial stout", "ipa", "india pale ale", "pale ale", "rye beer", "stock ale", "wheat beer"]},
    {"names": ["draft beer", "draught beer"],
     "note": "Pasteurized beer is draft only in large containers with a tap"},
    {"names": ["bavarian", "dortmund", "dortmunder", "kulmbacher", "munich", "munchner", "salvator", "wein", "weiner", "wurtzburger"],
     "produced_in": "Germany", "qualifier": _ELSEWHERE},
    {"names": ["vienna"],
     "produced_in": "Austria", "qualifier": _ELSEWHERE},
    {"names": ["pilsen", "pilsener", "pilsner", "pils"],
     "produced_in": "Czech Republic or United States", "qualifier": _ELSEWHERE},
    {"names": ["black and tan", "half and half"],
     "sufficient": "false", "composition": "The designation must name both classes"},
    {"names": ["malt beverage specialty"],
     "sufficient": "false", "composition": "A distinctive name and a statement of composition are needed"},
]
WINE = [
    {"names": ["table wine", "light wine"]},
    {"names": ["dessert wine"]},
    {"names": ["red wine", "white wine", "rose wine", "pink wine", "amber wine"]},
    {"names": ["grape wine", "citrus wine", "fruit wine", "berry wine", "sparkling wine", "carbonated wine", "crackling wine", "petillant wine", "frizzante wine", "cremant wine", "perlant wine",
               "reciotto wine", "aperitif wine", "vermouth", "cider", "apple wine", "perry", "pear wine", "mead", "honey wine", "sake", "rice wine", "raisin wine", "muscadine", "muscat", "moscato",
               "muscatel", "light muscatel", "scuppernong"]},
    {"names": ["champagne"],
     "kind": "semi_generic", "produced_in": "France"},
    {"kind": "semi_generic", "names": ["burgundy", "chablis", "chianti", "claret", "malaga", "marsala", "moselle", "rhine wine", "hock", "sauterne", "haut sauterne", "tokay", "sherry", "light sherry", "madeira", "light madeira",
               "port", "light port", "angelica", "light angelica", "retsina"]},
    {"kind": "foreign_nongeneric", "produced_in": "France", "qualifier": "The name of one French wine",
     "names": ["aloxe corton", "alsace", "vin d alsace", "anjou", "barsac", "batard montrachet", "beaujolais", "beaujolais villages", "beaune", "bonnes mares", "bordeaux", "bordeaux blanc", "bordeaux rouge", "bourgogne", "brouilly", "chambertin",
               "chambolle musigny", "charmes chambertin", "chassagne montrachet", "chateau lafite", "chateau margaux", "chateau yquem", "chateauneuf du pape", "chenas", "chevalier montrachet", "chiroubles", "clos de la roche", "clos de vougeot",
               "corton", "corton charlemagne", "cote de beaune", "cote de beaune villages", "cote de brouilly", "cote de nuits", "cote de nuits villages", "cote rotie", "coteaux du layon", "cotes du rhone", "echezeaux", "entre deux mers", "fleurie",
               "gevrey chambertin", "grands echezeaux", "graves", "haut medoc", "hermitage", "la tache", "loire", "macon", "margaux", "medoc", "mercurey", "meursault", "montrachet", "morgon", "moulin a vent", "muscadet", "musigny", "nuits",
               "nuits saint georges", "pauillac", "pomerol", "pommard", "pouilly fuisse", "pouilly fume", "puligny montrachet", "rhone", "richebourg", "romanee conti", "romanee saint vivant", "rose d anjou", "saint amour", "saint emilion",
               "saint estephe", "saint julien", "sancerre", "santenay", "saumur", "savigny", "savigny les beaunes", "tavel", "touraine", "volnay", "vosne romanee", "vouvray"]},
    {"kind": "foreign_nongeneric", "produced_in": "Italy", "qualifier": "The name of one Italian wine",
     "names": ["asti spumante", "barbaresco", "barbera d alba", "barbera d asti", "bardolino", "barolo", "brunello di montalcino", "dolcetto d alba", "frascati", "gattinara", "lacryma christi", "nebbiolo d alba", "orvieto", "soave", "valpolicella",
               "vino nobile de montepulciano"]},
    {"kind": "foreign_nongeneric", "produced_in": "Germany", "qualifier": "The name of one German wine",
     "names": ["bernkasteler doctor", "bernkasteler doktor", "deidesheimer", "dexheimer doktor", "erbacher marcobrunn", "forster", "forster jesuitengarten", "graacher himmelreich", "liebfraumilch", "liebfrauenmilch", "mosel", "mosel saar ruwer",
               "ockfener bockstein", "piesporter goldtropfchen", "piesporter michelsberg", "piesporter treppchen", "rudesheimer", "scharzhofberger", "schloss johannisberger", "schloss vollrads", "wehlener sonnenuhr", "zeller schwarze katz"]},
    {"kind": "foreign_nongeneric", "produced_in": "Portugal", "qualifier": "The name of one Portuguese wine",
     "names": ["dao", "oporto", "porto", "vinho do porto"]},
    {"kind": "foreign_nongeneric", "produced_in": "Spain", "qualifier": "The name of one Spanish wine",
     "names": ["lagrima", "rioja"]},
    {"names": ["substandard wine", "other than standard wine", "imitation wine"],
     "sufficient": "false", "composition": "The class or type that it would be must be named"},
    {"names": ["wine specialty"],
     "sufficient": "false", "composition": "A statement of composition is needed on the brand label"},
]
SPIRITS = [
    {"names": ["neutral spirits", "alcohol", "vodka", "grain spirits"],
     "min_abv": 40.0},
    {"names": ["gin", "distilled gin", "compounded gin", "redistilled gin"],
     "min_abv": 40.0},
    {"names": ["bourbon whisky", "straight bourbon whisky", "whisky distilled from bourbon mash"],
     "min_abv": 40.0},
    {"names": ["rye whisky", "wheat whisky", "malt whisky", "rye malt whisky", "corn whisky", "straight rye whisky", "straight wheat whisky", "straight malt whisky", "straight rye malt whisky",
               "straight corn whisky", "straight whisky", "whisky distilled from rye mash", "whisky distilled from wheat mash", "whisky distilled from malt mash", "whisky distilled from rye malt mash"],
     "min_abv": 40.0, "produced_in": "United States", "qualifier": _ELSEWHERE},
    {"names": ["light whisky", "blended light whisky", "light whisky a blend"],
     "min_abv": 40.0},
    {"names": ["blended whisky", "whisky a blend", "blended bourbon whisky", "blended rye whisky", "blended wheat whisky", "blended malt whisky", "blended rye malt whisky", "blended corn whisky",
               "bourbon whisky a blend", "spirit whisky"],
     "min_abv": 40.0},
    {"names": ["a blend of straight whiskies", "blended straight whiskies", "blended straight bourbon whiskies", "a blend of straight bourbon whiskies", "a blend of straight rye whiskies",
               "a blend of straight wheat whiskies", "a blend of straight malt whiskies", "a blend of straight rye malt whiskies", "a blend of straight corn whiskies"],
     "min_abv": 40.0},
    {"names": ["whisky"],
     "sufficient": "conditional", "min_abv": 40.0, "note": "Enough alone only for blends of two or more types of whisky, or a type treated with unusual materials"},
    {"names": ["scotch whisky", "blended scotch whisky", "scotch whisky a blend"],
     "min_abv": 40.0, "produced_in": "Scotland"},
    {"names": ["irish whisky", "blended irish whisky"],
     "min_abv": 40.0, "produced_in": "Ireland or Northern Ireland"},
    {"names": ["canadian whisky", "blended canadian whisky", "canadian whisky a blend"],
     "min_abv": 40.0, "produced_in": "Canada"},
    {"names": ["rum"],
     "min_abv": 40.0},
    {"names": ["tequila"],
     "min_abv": 40.0, "produced_in": "Mexico"},
    {"names": ["mescal", "mezcal"],
     "min_abv": 40.0, "produced_in": "Mexico"},
    {"names": ["brandy"],
     "min_abv": 40.0},
    {"names": ["fruit brandy", "apple brandy", "applejack", "kirschwasser", "slivovitz", "immature brandy", "pisco", "raisin brandy", "lees brandy", "pomace brandy", "marc brandy", "grappa",
               "grappa brandy", "residue brandy", "neutral brandy", "substandard brandy", "blended applejack", "applejack a blend", "dried fruit brandy"],
     "min_abv": 40.0},
    {"names": ["cognac", "armagnac", "calvados"],
     "min_abv": 40.0, "produced_in": "France"},
    {"names": ["liqueur", "cordial", "sloe gin", "amaretto", "kummel", "ouzo", "anise", "anisette", "peppermint schnapps", "triple sec", "curacao", "rye liqueur", "rye cordial", "bourbon liqueur",
               "bourbon cordial", "rum liqueur", "rum cordial", "gin liqueur", "gin cordial", "brandy liqueur", "brandy cordial", "arak", "arack", "raki"],
     "min_abv": 30.0},
    {"names": ["rock and rye", "rock and bourbon", "rock and brandy", "rock and rum"],
     "min_abv": 24.0},
    {"names": ["sambuca"],
     "min_abv": 30.0, "produced_in": "Italy", "qualifier": _ELSEWHERE},
    {"names": ["goldwasser"],
     "min_abv": 30.0, "produced_in": "Germany", "qualifier": _ELSEWHERE},
    {"names": ["creme de menthe", "creme de cacao", "creme de almond", "creme de cassis", "creme de banana", "creme de peach"],
     "min_abv": 30.0},
    {"names": ["flavored brandy", "flavored gin", "flavored rum", "flavored vodka", "flavored whisky"],
     "sufficient": "conditional", "min_abv": 30.0, "composition": "The predominant flavor must be part of the designation"},
    {"names": ["advocaat", "aquavit", "bitters"]},
    {"names": ["distilled spirits specialty"],
     "sufficient": "false", "composition": "A distinctive name and a statement of composition are needed"},
]

#: The shipped entries as rows of ENTRY.
DEFAULT: list[dict] = [
    {"commodity": commodity, "entry": i, "kind": "class_or_type", "sufficient": "true"} | e
    for commodity, entries in (("malt", MALT), ("wine", WINE), ("spirits", SPIRITS)) for i, e in enumerate(entries)
]


def load(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of JSON lines with the columns of ENTRY."""
    return spark.read.schema(ENTRY).json(path)


def violations(dim: DataFrame) -> DataFrame:
    """(commodity, entry, problem): what is wrong with a catalogue's entries; a sound one has no rows. Repeated entry numbers of a commodity are one problem each."""
    name = lambda n: X.presence(n).isNotNull()
    rules = {
        "unknown commodity": ~F.coalesce(F.col("commodity").isin(*COMMODITIES), F.lit(False)),
        "entry number missing": F.col("entry").isNull(),
        "names must not be empty": F.coalesce(F.size("names"), F.lit(0)) <= 0,
        "blank name": ~F.coalesce(F.forall("names", name), F.lit(True)),
        "kind missing": X.presence(F.col("kind")).isNull(),
        "sufficient must be true, false or conditional": ~F.coalesce(F.col("sufficient").isin(*SUFFICIENT), F.lit(False)),
        "least alcohol must be positive": F.coalesce(F.col("min_abv") <= 0, F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules.items()]), lambda x: x.isNotNull())
    rows = dim.select("commodity", "entry", F.explode(found).alias("problem"))
    twice = dim.groupBy("commodity", "entry").count().filter("count > 1").select("commodity", "entry", F.lit("entry number repeated").alias("problem"))
    return rows.unionByName(twice)


def entries_of(dim: DataFrame, most: int = MOST_ENTRIES) -> list[dict]:
    """A catalogue's rows, checked: raises ValueError if it has violations, or more than most entries."""
    bad = violations(dim).take(1)
    if bad:
        raise ValueError(f"catalogue: {bad[0]['commodity']} entry {bad[0]['entry']}: {bad[0]['problem']}")
    rows = dim.withColumn("names", F.transform("names", lambda n: folded(n))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"catalogue: more than {most} entries")
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: (r["commodity"], r["entry"]))


def folded(c: Column) -> Column:
    return X.fold_whisky(X.normalize(c))


def _literal(entries: Sequence[dict], commodity: str) -> Column:
    """The commodity's entries; padded holds their names between spaces."""
    rows = [e | {"padded": [f" {n} " for n in e["names"]]} for e in entries if e["commodity"] == commodity]
    kinds = [x.split(" ") for x in ENTRY.split(", ")]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<" + ",".join(f"{n}:{kind}" for n, kind in [*kinds, ["padded", "array<string>"]]) + ">>")


def lookup(text: Column, commodity: Column, entries: Sequence[dict] = tuple(DEFAULT)) -> Column:
    """The entry of commodity that a normalised, folded text names: equal to a name before containing one between token borders, then the first. Null if none."""
    def best(of: str, padded: Column) -> Column:
        tier = lambda e: F.when(F.array_contains(e["padded"], padded), 0).when(F.exists(e["padded"], lambda n: F.contains(padded, n)), 1)
        hits = F.transform(_literal(entries, of), lambda e: F.struct(tier(e).alias("tier"), e["entry"].alias("entry"), e.alias("found")))
        return F.array_min(F.filter(hits, lambda h: h["tier"].isNotNull()))["found"]

    def of_kind(padded: Column) -> Column:
        out = None
        for of in COMMODITIES:
            out = F.when(commodity == of, best(of, padded)) if out is None else out.when(commodity == of, best(of, padded))
        return F.when(padded != "  ", out)

    # an array of one binds the text, so that it is normalised once and not for every name
    return F.get(F.transform(F.array(F.concat(F.lit(" "), text, F.lit(" "))), of_kind), F.lit(0))


def other_commodity(text: Column, own: Column, entries: Sequence[dict] = tuple(DEFAULT)) -> Column:
    """The first commodity but own of which a name equals the text."""
    names = lambda of: F.array(*map(F.lit, sorted({n for e in entries if e["commodity"] == of for n in e["names"]}))).cast("array<string>")
    return F.coalesce(*[F.when((own != of) & F.array_contains(names(of), text), F.lit(of)) for of in COMMODITIES])
