"""chronolake.streaming"""
