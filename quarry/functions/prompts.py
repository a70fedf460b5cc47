"""Few-shot chat prompts (E3, E4) as ARRAY<STRUCT<role, content>> column expressions.

The system text and the example pairs are literals, so Catalyst folds them into one constant array;
only the final user message is built per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query-rewriting prompt (system text, label, example pairs) used by the reference.
REWRITE_SYSTEM = ("Ты — система очистки поисковых запросов технической поддержки. "
                  "Перепиши запрос пользователя, сохранив только ключевую суть проблемы. "
                  "Убери извинения, вежливость, лишние детали.")
REWRITE_LABEL = "Запрос: "
REWRITE_SHOTS = [
    ("ой, извините, пожалуйста, я тут случайно удалила всё, что делать? помогите",
     "восстановление данных после случайного удаления"),
    ("здравствуйте, у меня не открывается сайт, в чем может быть проблема?",
     "сайт не открывается"),
    ("помогите, как сбросить счетчик просмотров, я нажимал на кнопку но ничего",
     "сброс счетчика просмотров"),
    ("привет! а можно удалить старый аккаунт и привязать новый номер?",
     "удаление аккаунта и смена номера телефона"),
    ("извините за беспокойство, а как привязать карту к аккаунту?",
     "привязка банковской карты к аккаунту"),
]

# Title-generation prompt (system text and label) used by the reference.
TITLE_SYSTEM = ("Ты — система генерации кратких описаний статей справки. "
                "По началу статьи напиши короткую фразу (3-10 слов), "
                "которая отражает ключевую суть проблемы или инструкции. "
                "Используй ключевые термины, как если бы пользователь искал эту статью.")
TITLE_LABEL = "Начало статьи: "
# Our own neutral examples; callers with articles of their own pass theirs.
TITLE_SHOTS = [
    ("Чтобы вернуть заказ, откройте раздел с покупками, выберите посылку и укажите причину возврата.",
     "оформление возврата заказа"),
    ("Если код подтверждения не пришёл, проверьте номер телефона и запросите код ещё раз через минуту.",
     "не приходит код подтверждения"),
    ("Квитанцию об оплате можно скачать в личном кабинете на странице платежей.",
     "скачивание квитанции об оплате"),
]


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompt(col, system: str, shots: list[tuple[str, str]], label: str) -> Column:
    """System message, then (user: label + example, assistant: answer) per shot, then user: label + col."""
    msgs = [_msg("system", F.lit(system))]
    for q, a in shots:
        msgs += [_msg("user", F.lit(label + q)), _msg("assistant", F.lit(a))]
    c = F.col(col) if isinstance(col, str) else col
    msgs.append(_msg("user", F.concat(F.lit(label), c)))
    return F.array(*msgs)


def rewrite_prompt(col) -> Column:
    """Prompt for rewriting a user query."""
    return build_prompt(col, REWRITE_SYSTEM, REWRITE_SHOTS, REWRITE_LABEL)


def title_prompt(col, shots: list[tuple[str, str]] = TITLE_SHOTS) -> Column:
    """Prompt for a short article title; pass the article head (P2), and example pairs (head, title) of one's own."""
    return build_prompt(col, TITLE_SYSTEM, shots, TITLE_LABEL)


# Our own prompt for document expansion: queries that a part of an article answers.
EXPANSION_SYSTEM = ("Ты — система генерации поисковых запросов. По фрагменту статьи справки напиши один запрос, "
                    "на который этот фрагмент отвечает.")
EXPANSION_LABEL = "Фрагмент: "
EXPANSION_SHOTS = [
    ("Пароль можно сменить в настройках профиля: откройте раздел безопасности и введите новый пароль дважды.",
     "как сменить пароль"),
    ("Если посылка не пришла в срок, напишите в поддержку и приложите номер отправления.",
     "что делать, если посылка не пришла"),
]


def expansion_prompt(col) -> Column:
    """Prompt for a query that the given part of an article answers."""
    return build_prompt(col, EXPANSION_SYSTEM, EXPANSION_SHOTS, EXPANSION_LABEL)
