"""The algebra of units, and quantities in titles made of part names."""

import random
from pathlib import Path

import pandas as pd
import pytest

from tallygrain.functions import quantity as q
from tallygrain.functions import units

DATA = Path("/root/testdata/sf0.01/part.parquet")


@pytest.mark.parametrize(
    ("written", "same"),
    [("kWh", "kilowatt-hours"), ("mAh", "milliampere hour"), ("cm³", "ml"), ("cubic centimetres", "cc"), ("dm^3", "litre"), ("sq m", "m2"), ("V·A", "W"), ("J/s", "watts"), ("MB/s", "megabytes per second"), ("fl. oz", "fluid ounces"), ("N·m", "joules"), ("Mbps", "Mbit/s"), ("pound-mass", "lbs"), ("kilometers per hour", "km/h")],
)
def test_written_forms_of_one_unit(written, same):
    a, b = (q.measure(q.tokens_of(x), 0) for x in (written, same))
    assert a[0] == len(q.tokens_of(written)) and a[1].same(b[1])


def test_units_are_told_apart():
    form = lambda x: q.measure(q.tokens_of(x), 0)[1]
    assert not form("mW").same(form("MW")) and not form("VA").same(form("W")) and not form("m2").same(form("m"))
    assert form("m/s").dims == (1, 0, -1, 0, 0, 0) and (form("W") / form("V")).same(form("A"))
    assert q.measure(q.tokens_of("kg/bag"), 0)[1] is None and q.measure(q.tokens_of("kgs2"), 0) is None and units.symbol("k") is None


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("Flour 1/2 kg", {"weight_g": 500}), ("Juice 1 1/2 l", {"volume_ml": 1500}), ("Milk ½ litre", {"volume_ml": 500}), ("Milk 1½ l", {"volume_ml": 1500}),
        ("Cat 5-10 kg", {"weight_g": 7500}), ("Rope 2 to 4 metres", {"length_mm": 3000}), ("Part 10 ± 1 kg", {"weight_g": 10000}), ("Cat 10-5 kg", {}),
        ("Phone 16-128GB", {}), ("iPhone 16 - 128GB", {"storage_gb": 128}), ("Engine 250 cm³", {"volume_ml": 250}), ("Engine 250cm3", {"volume_ml": 250}),
        ("Tank 3 cubic centimetres", {"volume_ml": 3}), ("Rug 6 m2", {}), ("Rug 6 sq m", {}), ("Battery 2 kWh", {}), ("UPS 500 VA", {}), ("Pump 5 l/min", {}),
        ("Salt 3 g per litre", {}), ("Rice 5 kg/bag", {}), ("Beans 5 g per 100 ml", {"weight_g": 5, "volume_ml": 100}), ("Cola 500ml/16oz", {"volume_ml": 500, "weight_g": 453.592}),
        ("Pack 6x500g/tray", {"count": 6, "weight_g": 500}), ("Cell 2500 milliampere-hours", {"charge_mah": 2500}), ("Cell 2 AH", {"charge_mah": 2000}), ("Pen 5 ft", {}),
        ("Oven 2.2 kilowatts 230 volts", {"power_w": 2200, "voltage_v": 230}), ("Radio 5 MW", {}), ("Gel 1,5 centilitres", {"volume_ml": 15}), ("", {}), ("½", {}), ("1/", {}), ("5 kg to", {"weight_g": 5000}),
    ],
)
def test_amounts(title, expected):
    assert q.parse(title) == pytest.approx(expected)


FORMS = [  # how a value in the unit is written, and what it is worth
    ("{n} {u}", lambda n: n), ("{n}{s}", lambda n: n), ("{n}-{u}", lambda n: n), ("{n}.5 {s}", lambda n: n + 0.5), ("{n} 3/4 {u}", lambda n: n + 0.75),
    ("{n}¼ {u}", lambda n: n + 0.25), ("{n}-{m} {s}", lambda n: n + 1), ("{n} to {m} {u}", lambda n: n + 1), ("{n} ± 1 {s}", lambda n: n), ("{n} {s}/{s}", lambda n: None), ("{n} {u} per second", lambda n: None),
]
SIZES = [("g", "grams", "weight_g", 1), ("kg", "kilograms", "weight_g", 1000), ("ml", "milliliters", "volume_ml", 1), ("cl", "centilitres", "volume_ml", 10), ("mm", "millimetres", "length_mm", 1), ("cm", "centimeters", "length_mm", 10), ("kW", "kilowatts", "power_w", 1000), ("mV", "millivolts", "voltage_v", 0.001)]


def test_generated_titles_of_parts():
    names = pd.read_parquet(DATA, columns=["p_name"]).p_name.sort_values().drop_duplicates().tolist()
    rng = random.Random(8)
    for i in range(400):
        form, worth = FORMS[i % len(FORMS)]
        short, long, attr, factor = rng.choice(SIZES)
        n = rng.randint(2, 90)
        written = form.format(n=n, m=n + 2, s=short, u=long)
        name = rng.choice(names)
        title = f"{name} {written}" if i % 2 else f"{written}, {name}"
        want = {} if worth(n) is None else {attr: worth(n) * factor}
        assert q.parse(title) == pytest.approx(want), title
