"""Function words, and other closed word classes, of the languages in the data."""

# Common function words by language, in alphabetical order.
FUNCTION_WORDS = {
    "en": "a about after all although always an and are as at be because been before both but by can cannot could did do does during each even every for from had has have he her here his how if in into is it its many may more most must no not of on once one only or other our over shall she should since so some such than that the their them then there these they this those through to too two under unless until up us very was we were what when where whether which while who why will with within without would you your".split(),
    "es": "a además al así aunque como con cuando de del desde donde después dos durante e el ella ellos en entre era es esa ese esta este están esto está fue ha hasta hay la las le les lo los muy más muchos ni no nos o para pero podrían por porque primer puede que qué se según ser si sin sobre son su sus también tan tanto un una uno y ya".split(),
    "fr": "a ainsi alors après au aussi autre aux avant avec ce cela ces cet cette chaque comme c d'une dans de des deux donc du d elle elles en entre est et fait il ils je l la le les leur leurs lorsque lui mais même ne nous on ont ou où par parce pas pendant peut plus plusieurs pour pourquoi pourraient qu que qui sa sans se sera ses si son sont sous sur tout toute tous très un une vers vous y à été être".split(),
    "de": "aber alle als also am an auch auf aus außerdem bei beim bis da dadurch dafür damit dann das dass davon dem den denn der des deshalb die dies diese diesen dieser doch du durch ein eine einem einen einer eines er es für hat haben ich ihr ihre im in ist ja jede kann kein keine können könnten man mehr mit nach nicht noch nur oder ohne sehr sein seine sich sie sind so um und uns unter viele vom von vor wann war warum was weil welche wenn wer wie wir wird wo während zu zum zur zuerst über".split(),
    "hi": "इस इसका इसके इसलिए इससे इसे उस उसके एक और कर करता करते करने का कि की के को कई क्या क्यों क्योंकि गया जब जा जो तक तथा तो था थी थे द्वारा दोनों ने पर परंतु बहुत बिना भी में यदि यह या ये रहते रूप लिए वह वे से हैं है हो होता होती होते".split(),
}
ALL_FUNCTION_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)

# Articles, prepositions and the plain conjunctions; they also join the words of a mere name or term.
NOMINAL_WORDS = frozenset(
    "a an and at before by for from in of on or the to with"
    " a al con de del e el en la las los o para por sin u un una y"
    " au aux avec c d de des du en et l la le les ou par pour sans sur un une à"
    " am an auf aus bei beim das dem den der des die ein eine für im in mit nach oder und vom von zu zum zur"
    " और का की के को में पर से".split()
)
