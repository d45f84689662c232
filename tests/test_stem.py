"""The published examples of each step of Porter's algorithm, and token lists."""
from postlens.functions.stem import stems
from postlens.operators import clean as C

# Words and their final stems, after the examples in Porter (1980).
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control
roll roll generalizations gener oscillators oscil yes ye yellow yellow by by i i über über""".split()


def test_published_examples(spark):
    pairs = list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))
    df = spark.createDataFrame([*pairs, (None, None)], "term string, want string")
    bad = [(r.term, r.stem, r.want) for r in stems(df).collect() if r.stem != r.want]
    assert not bad


def test_lists_with_repeated_ids_stay_apart(spark):
    tok = spark.createDataFrame([("p", ["mice", "running", "mice"]), ("p", ["cats"]), ("q", []), ("r", None)], "post_id string, tokens array<string>")
    lem = spark.createDataFrame([("mice", "mouse"), ("mice", "nouse"), ("cats", None)], "token string, lemma string")
    got = sorted((r.post_id, r.tokens) for r in C.normalize_tokens(tok, lem, stem=True).collect())
    assert got == [("p", ["cat"]), ("p", ["mouse", "run", "mouse"]), ("q", []), ("r", [])]
