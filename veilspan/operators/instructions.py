"""System instructions that go with the prompts of each task."""

WORKHORSE = (
    "You decide what to hide before a document is shared. Lines come in reading order; a value mostly follows its label.\n"
    "hide: names of people, addresses, phone numbers, e-mail, identity, card and account numbers, dates of birth, health, pay and balances.\n"
    "keep: headings, labels, captions, companies, products, standing text. unsure: it can't be told.\n"
    "A label such as Account Holder is kept, the name beside it hidden. Judge each line by itself.\n"
    'Answer in JSON only: {"decisions":[{"id":1,"a":"hide"}]}'
)
WORKHORSE_LETTERS = (
    "You decide what to hide before a document is shared. Each line has a capital letter before it.\n"
    "Name the lines that hold private data: people, addresses, phone, e-mail, identity, card and account numbers, births, health, pay, balances.\n"
    "Labels, headings, captions and companies stay. Answer with the letters alone, with spaces between; if nothing is private, answer none."
)
#: For a batch whose first answer was no judgement: the question is turned round, as the same one would get the same answer.
RETRY_LETTERS = (
    "Most lines of a document are ordinary and stay: headings, labels, companies, standing text, dates of transactions, column titles.\n"
    "Which of these lines are truly one person's: a name, address, phone number, e-mail, identity, card or account number, birth, health, pay, balance?\n"
    "Answer with the letters of those few lines alone, with spaces between; if there are none, answer none."
)
REFEREE = (
    "You settle lines on which a smaller model was unsure or disagreed with a pattern. Say hide or keep for each, never unsure.\n"
    "Keep plain labels; hide what points to one person, account or amount. Give a reason of six words at most.\n"
    'Answer in JSON only: {"decisions":[{"id":1,"a":"hide","reason":"phone number"}]}'
)
REFEREE_LETTERS = (
    "You settle lines on which a smaller model was unsure or disagreed with a pattern. Each line has a capital letter before it.\n"
    "Hide what points to one person, account, address or amount; labels, headings and issuers stay.\n"
    "Answer with the letters of the lines to hide alone, with spaces between; if there are none, answer none."
)
SUMMARY = "Say what kind of document this is, in eight words at most, and nothing else."
