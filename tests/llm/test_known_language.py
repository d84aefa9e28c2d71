"""Gibberish and a language without a profile are not of a known language."""

import random

from loomline.llm import language_id
from loomline.session import ship_package

R = random.Random(2)
LEARNED = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood everyone has the right to life liberty and security of person".split(),
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geiste der brüderlichkeit begegnen jeder hat das recht auf leben freiheit und sicherheit der person".split(),
}
POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"


def test_unknown_languages_go(spark):
    ship_package(spark)
    rows = [(i, " ".join(R.choices(LEARNED[x], k=80)), x) for i, x in enumerate(["en", "de"] * 40)]
    rows += [(100, "".join(R.choices("abcdefghijklmnopqrstuvwxyz     ", k=2000)), None), (101, POLISH, None), (102, "123 456", None), (103, None, None)]
    got = {r.doc_id for r in language_id.known_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == set(range(80))
