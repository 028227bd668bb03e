"""Stopword sets by language, in alphabetical order: those
that indexes of the published form are built with, so that terms agree."""


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


ENGLISH = _set(
    """
    a an and are as at be but by can could did do does for he how i if in into is it me mean meaning
    no not of on or please she should such tell that the their then there these they this to was we
    what when where which who whom will with would you
    """
)
GERMAN = _set(
    """
    aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes
    anderm andern anderr anders auch auf aus bei bin bis bist da damit dann das daß dem demselben
    den der derselbe derselben des die diese dieselbe dieselben diesem diesen dieser dieses doch
    dort durch ein eine einem einen einer eines einig einige einigem einigen einiger einiges einmal
    er es etwas euch euer eure eurem euren eurer eures für gegen gewesen hab habe haben hat hatte
    hatten hier hin hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer ihres im in indem ins ist
    jede jedem jeden jeder jedes jene jenem jenen jener jenes jetzt kann kein keine keinem keinen
    keiner keines können könnte machen man manche manchem manchen mancher manches mein meine meinem
    meinen meiner meines mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr
    sein seine seinem seinen seiner seines selbst sich sie sind so solche solchem solchen solcher
    solches soll sollte sondern sonst um und uns unser unsere unserem unseren unseres unter viel vom
    von vor war waren warst was weg weil weiter welche welchem welchen welcher welches wenn werde
    werden wie wieder will wir wird wirst wo wollen wollte während würde würden zu zum zur zwar
    zwischen über
    """
)
DUTCH = _set(
    """
    aan als dat de die een en geen heb het hier hoe hoeveel ik in is maar met mij mijn niet niets om
    omdat ook over t te tot van voor we wij worden zijn
    """
)
SWEDISH = _set(
    """
    alla allt att av blev bli blir blivit de dem den denna deras dess dessa det detta dig din dina
    ditt du där då efter ej eller en er era ert ett från för ha hade han hans har henne hennes hon
    honom hur här i icke ingen inom inte jag ju kan kunde man med mellan men mig min mina mitt mot
    mycket ni nu när någon något några och om oss på samma sedan sig sin sina sitta själv skulle som
    så sådan sådana sådant till under upp ut utan vad var vara varför varit varje vars vart vem vi
    vid vilka vilkas vilken vilket vår våra vårt än är åt över
    """
)
NORWEGIAN = _set(
    """
    alle at av da deg den denne der dere deres det ditt du en er et for fra ha hadde han hos hun hva
    hvem hver hvilke hvilken hvilket hvis hvor hvordan hvorfor hvorvidt i ikke jeg meg men mitt noen
    nå når og over på seg selv sin sine skal skulle som så til var ved
    """
)
SHORT_ENGLISH = _set(
    """
    a and are as at be but by for if in into is it no not of on or such that the their then there
    these they this to was will with
    """
)
THAI = _set(
    """
    กัน การ ก็ ของ ความ จะ จาก ซึ่ง ด้วย ที่ ผู้ มา มี เป็น และ ใน ให้ ได้ ไป
    """
)
