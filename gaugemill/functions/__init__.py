"""Column builders: text normal forms, amounts, dates, identifiers, check digits, money formats, comparators."""
