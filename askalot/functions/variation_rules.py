"""Rules by which an answer option can be said otherwise, a pair a line."""

from __future__ import annotations


# Words that can stand for each other.
WORDS: list[tuple[str, str]] = [
    ("Strongly", "Completely"),
    ("Strongly", "Totally"),
    ("Completely", "Totally"),
    ("Completely", "Absolutely"),
    ("Extremely", "Very"),
    ("Extremely", "Absolutely"),
    ("Absolutely", "Completely"),
    ("Very", "Quite"),
    ("Very", "Highly"),
    ("Quite", "Fairly"),
    ("Fairly", "Reasonably"),
    ("Rather", "Fairly"),
    ("Rather", "Quite"),
    ("Somewhat", "Fairly"),
    ("Somewhat", "Moderately"),
    ("Somewhat", "Partially"),
    ("Somewhat", "Rather"),
    ("Mostly", "Generally"),
    ("Mostly", "Largely"),
    ("Mostly", "Mainly"),
    ("Moderately", "Fairly"),
    ("Moderately", "Reasonably"),
    ("Slightly", "A little"),
    ("Slightly", "Marginally"),
    ("Slightly", "Somewhat"),
    ("A little", "Marginally"),
    ("A little", "Slightly"),
    ("Always", "Every time"),
    ("Always", "Invariably"),
    ("Often", "Frequently"),
    ("Often", "Regularly"),
    ("Sometimes", "Occasionally"),
    ("Sometimes", "At times"),
    ("Rarely", "Seldom"),
    ("Rarely", "Hardly ever"),
    ("Rarely", "Infrequently"),
    ("Never", "Not at all"),
    ("Never", "Not ever"),
    ("Much", "A lot"),
    ("Much", "Considerably"),
    ("Little", "Not much"),
    ("Little", "Slightly"),
    ("Good", "Positive"),
    ("Bad", "Negative"),
    ("Excellent", "Outstanding"),
    ("Excellent", "Very good"),
    ("Poor", "Bad"),
    ("Poor", "Inadequate"),
    ("Fair", "Adequate"),
    ("Fair", "Average"),
    ("Fair", "Reasonable"),
    ("Terrible", "Awful"),
    ("Terrible", "Very bad"),
    ("Complete", "Total"),
    ("Complete", "Full"),
    ("Total", "Full"),
    ("Great", "High"),
    ("Great", "Considerable"),
    ("Likely", "Probable"),
    ("Unlikely", "Improbable"),
    ("Support", "Favor"),
    ("Oppose", "Against"),
    ("Difficult", "Hard"),
    ("Easy", "Simple"),
    ("Safe", "Secure"),
    ("Unsafe", "Insecure"),
    ("Dangerous", "Unsafe"),
]

# Whole options that mean the same.
PHRASES: list[tuple[str, str]] = [
    ("Neither agree nor disagree", "Neutral"),
    ("Neither agree nor disagree", "No opinion"),
    ("Neither agree or disagree", "Neutral"),
    ("Agree with neither", "Neutral"),
    ("Neither satisfied nor dissatisfied", "Neutral"),
    ("Neither good nor bad", "Neutral"),
    ("Neither good, nor bad", "Neutral"),
    ("Neither bad nor good", "Neutral"),
    ("Neither important nor unimportant", "Neutral"),
    ("Neither likely nor unlikely", "Neutral"),
    ("Neither positive nor negative", "Neutral"),
    ("Neither trust nor distrust", "Neutral"),
    ("Neither approve nor disapprove", "Neutral"),
    ("Neither happy nor unhappy", "Neutral"),
    ("Neither worse nor better", "No change"),
    ("Neither better nor worse", "No change"),
    ("Not at all important", "Not important"),
    ("Not at all important", "Unimportant"),
    ("Very important", "Extremely important"),
    ("Somewhat important", "Fairly important"),
    ("Not very important", "Not so important"),
    ("Absolutely essential", "Essential"),
    ("Trust completely", "Complete trust"),
    ("Trust completely", "Full trust"),
    ("Trust somewhat", "Some trust"),
    ("No trust at all", "Complete distrust"),
    ("Do not trust at all", "No trust"),
    ("Do not trust very much", "Little trust"),
    ("A great deal of trust", "Complete trust"),
    ("Quite a lot of trust", "High trust"),
    ("Not a lot of trust", "Low trust"),
    ("Not very much trust", "Little trust"),
    ("Not at all satisfied", "Completely dissatisfied"),
    ("Not very satisfied", "Somewhat dissatisfied"),
    ("Completely satisfied", "Fully satisfied"),
    ("Fairly satisfied", "Quite satisfied"),
    ("Very often", "Frequently"),
    ("Fairly often", "Often"),
    ("Not very often", "Rarely"),
    ("Not at all often", "Never"),
    ("Hardly ever", "Rarely"),
    ("Almost never", "Rarely"),
    ("Very likely", "Extremely likely"),
    ("Not very likely", "Somewhat unlikely"),
    ("Not at all likely", "Very unlikely"),
    ("Not likely at all", "Very unlikely"),
    ("Very good", "Excellent"),
    ("Very bad", "Terrible"),
    ("Fairly good", "Good"),
    ("Fairly bad", "Bad"),
    ("Strongly agree", "Completely agree"),
    ("Strongly disagree", "Completely disagree"),
    ("Agree strongly", "Completely agree"),
    ("Disagree strongly", "Completely disagree"),
    ("To a great extent", "Very much"),
    ("To some extent", "Somewhat"),
    ("To a small extent", "A little"),
    ("Not at all", "Not in any way"),
    ("To a medium extent", "To a moderate extent"),
    ("To a medium extent", "Moderately"),
    ("To a limited extent", "To a small extent"),
    ("To a large extent", "To a great extent"),
    ("A great deal", "A lot"),
    ("A great deal", "Very much"),
    ("A fair amount", "Quite a bit"),
    ("Not very much", "Little"),
    ("None at all", "Nothing"),
    ("Some", "A few"),
    ("Some", "Several"),
    ("All of them", "Every one of them"),
    ("Most of them", "The majority"),
    ("Some of them", "A few of them"),
    ("Few of them", "Not many of them"),
    ("Very much like me", "Exactly like me"),
    ("Like me", "Similar to me"),
    ("Somewhat like me", "A bit like me"),
    ("A little like me", "Slightly like me"),
    ("Not like me", "Unlike me"),
    ("Not like me at all", "Completely unlike me"),
    ("Very interested", "Extremely interested"),
    ("Fairly interested", "Quite interested"),
    ("Not very interested", "Somewhat uninterested"),
    ("Not at all interested", "Completely uninterested"),
    ("Very worried", "Extremely worried"),
    ("Fairly worried", "Quite worried"),
    ("Not very worried", "Somewhat unworried"),
    ("Not at all worried", "Not worried"),
    ("Very concerned", "Extremely concerned"),
    ("Not concerned at all", "Not worried at all"),
    ("Very democratic", "Fully democratic"),
    ("Fairly democratic", "Quite democratic"),
    ("Not very democratic", "Somewhat undemocratic"),
    ("Not at all democratic", "Completely undemocratic"),
    ("No democracy at all", "Not democratic at all"),
    ("Slight democracy", "Slightly democratic"),
    ("Some democracy", "Somewhat democratic"),
    ("A lot of democracy", "Very democratic"),
    ("Democratic to the greatest extent", "Fully democratic"),
    ("Much less democratic", "Far less democratic"),
    ("Much more democratic", "Far more democratic"),
    ("Much better", "A lot better"),
    ("A little better", "Slightly better"),
    ("About the same", "No change"),
    ("A little worse", "Slightly worse"),
    ("Much worse", "A lot worse"),
    ("Become stronger", "Strengthen"),
    ("Become weaker", "Weaken"),
    ("Become stronger", "Get stronger"),
    ("Become weaker", "Get weaker"),
    ("Remain the same", "Stay the same"),
    ("Become stronger than in previous years", "Strengthen compared to before"),
    ("Become weaker than in previous years", "Weaken compared to before"),
    ("Remain the same as in previous years", "Stay the same as before"),
    ("Stayed the same", "Remained the same"),
    ("Some influence", "Moderate influence"),
    ("No influence", "No impact"),
    ("Several times a day", "Multiple times daily"),
    ("Several times a week", "Multiple times weekly"),
    ("Several times a month", "Multiple times monthly"),
    ("Once a day", "Daily"),
    ("Once a week", "Weekly"),
    ("Once a month", "Monthly"),
    ("Every day", "Daily"),
    ("Every week", "Weekly"),
    ("Every month", "Monthly"),
    ("At least once a week", "Weekly or more"),
    ("At least once a month", "Monthly or more"),
    ("More than once a week", "Multiple times weekly"),
    ("A few times a week", "Several times weekly"),
    ("A few times a month", "Several times monthly"),
    ("A few times a year", "Several times yearly"),
    ("Less than once a month", "Less than monthly"),
    ("A few times", "Several times"),
    ("Many times", "Numerous times"),
    ("Once or twice", "A couple of times"),
    ("Just once or twice", "Only once or twice"),
    ("Only once", "Just once"),
    ("Most of the time", "Usually"),
    ("Most of the time", "Mostly"),
    ("Fully guaranteed", "Completely guaranteed"),
    ("Somewhat guaranteed", "Partially guaranteed"),
    ("Not guaranteed", "Unguaranteed"),
    ("Not at all guaranteed", "Completely unguaranteed"),
    ("Guaranteed to a medium extent", "Moderately guaranteed"),
    ("Guaranteed to a limited extent", "Somewhat guaranteed"),
    ("Not guaranteed at all", "Completely unguaranteed"),
    ("Guaranteed to a great extent", "Highly guaranteed"),
    ("Never justifiable", "Never justified"),
    ("Rarely justifiable", "Rarely justified"),
    ("Sometimes justifiable", "Sometimes justified"),
    ("Often justifiable", "Often justified"),
    ("Always justifiable", "Always justified"),
    ("Never justifiable", "Not justifiable"),
    ("Always justifiable", "Completely justifiable"),
    ("Not essential at all", "Completely unessential"),
    ("Not very essential", "Not particularly essential"),
    ("Somewhat essential", "Fairly essential"),
    ("Very essential", "Extremely essential"),
    ("Moderately essential", "Fairly essential"),
    ("Critical", "Crucial"),
    ("Important but not critical", "Important but not crucial"),
    ("Active member", "Actively participating"),
    ("Inactive member", "Non-active member"),
    ("Don't belong", "Not a member"),
    ("Neither applies nor not", "Neutral"),
    ("Neither acceptable nor unacceptable", "Neutral"),
    ("Neither undermined nor enriched", "No effect"),
    ("Neither bad nor good for the economy", "Neutral economic effect"),
    ("Neither gone too far nor should go further", "About right"),
    ("Agree with Statement 1", "Support Statement 1"),
    ("Agree with Statement 2", "Support Statement 2"),
    ("No contact", "No interaction"),
    ("Some contact", "Some interaction"),
    ("Balanced", "Even"),
    ("Have done", "Did this"),
    ("Might do", "Would consider doing"),
    ("Not close at all", "Not at all close"),
    ("Not very close", "Not particularly close"),
    ("Quite close", "Fairly close"),
    ("Most people can be trusted", "People can generally be trusted"),
    ("You can't be too careful", "You need to be careful"),
    ("Would not care", "Would be indifferent"),
    ("Would care a lot", "Would be very concerned"),
    ("None of them", "None"),
    ("None of these", "None of the above"),
    ("None of these are challenges", "None of the above"),
    ("Men more than women", "More men than women"),
    ("Women more than men", "More women than men"),
    ("Not effective at all", "Completely ineffective"),
    ("Not very effective", "Somewhat ineffective"),
    ("Quite effective", "Fairly effective"),
    ("Far left", "Extreme left"),
    ("Far right", "Extreme right"),
]

# The same words in another order.
REORDERED: list[tuple[str, str]] = [
    ("Strongly agree", "Agree strongly"),
    ("Strongly disagree", "Disagree strongly"),
    ("Somewhat agree", "Agree somewhat"),
    ("Somewhat disagree", "Disagree somewhat"),
    ("Completely agree", "Agree completely"),
    ("Completely disagree", "Disagree completely"),
    ("Totally agree", "Agree totally"),
    ("Totally disagree", "Disagree totally"),
    ("Very satisfied", "Satisfied, very"),
    ("Very dissatisfied", "Dissatisfied, very"),
    ("Completely satisfied", "Satisfied completely"),
    ("Completely dissatisfied", "Dissatisfied completely"),
    ("Extremely satisfied", "Satisfied, extremely"),
    ("Extremely dissatisfied", "Dissatisfied, extremely"),
    ("Somewhat satisfied", "Satisfied, somewhat"),
    ("Somewhat dissatisfied", "Dissatisfied, somewhat"),
    ("Very important", "Important, very"),
    ("Extremely important", "Important, extremely"),
    ("Not at all important", "Not important at all"),
    ("Somewhat important", "Important, somewhat"),
    ("Strongly support", "Support strongly"),
    ("Strongly oppose", "Oppose strongly"),
    ("Somewhat support", "Support somewhat"),
    ("Somewhat oppose", "Oppose somewhat"),
    ("Strongly favor", "Favor strongly"),
    ("Strongly approve", "Approve strongly"),
    ("Strongly disapprove", "Disapprove strongly"),
    ("Highly trust", "Trust highly"),
    ("Completely trust", "Trust completely"),
    ("Somewhat trust", "Trust somewhat"),
    ("Slightly trust", "Trust slightly"),
    ("Mostly trust", "Trust mostly"),
    ("Very likely", "Likely, very"),
    ("Very unlikely", "Unlikely, very"),
    ("Extremely likely", "Likely, extremely"),
    ("Somewhat likely", "Likely, somewhat"),
    ("Very often", "Often, very"),
    ("Quite often", "Often, quite"),
    ("Fairly often", "Often, fairly"),
    ("Very frequently", "Frequently, very"),
    ("Quite frequently", "Frequently, quite"),
    ("Very good", "Good, very"),
    ("Very bad", "Bad, very"),
    ("Extremely good", "Good, extremely"),
    ("Extremely bad", "Bad, extremely"),
    ("Fairly good", "Good, fairly"),
    ("Fairly bad", "Bad, fairly"),
    ("Very interested", "Interested, very"),
    ("Somewhat interested", "Interested, somewhat"),
    ("Very happy", "Happy, very"),
    ("Quite happy", "Happy, quite"),
    ("Not very happy", "Not happy, very"),
]

# Options without and with a pronoun.
PRONOUNS: list[tuple[str, str]] = [
    ("Agree", "I agree"),
    ("Disagree", "I disagree"),
    ("Satisfied", "I am satisfied"),
    ("Dissatisfied", "I am dissatisfied"),
    ("Approve", "I approve"),
    ("Disapprove", "I disapprove"),
    ("Support", "I support"),
    ("Oppose", "I oppose"),
    ("Yes", "Yes, I do"),
    ("No", "No, I don't"),
    ("Yes", "Yes, I have"),
    ("No", "No, I haven't"),
    ("Trust", "I trust"),
    ("Trust completely", "I trust completely"),
    ("Trust somewhat", "I trust somewhat"),
    ("Interested", "I am interested"),
    ("Not interested", "I am not interested"),
]
